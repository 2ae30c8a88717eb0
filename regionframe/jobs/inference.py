"""Whole analyses: agglomeration of every permutation, size-adjusted inference, cluster enhancement, sampled masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.jobs.graph import _leaf_stats, neighbour_edges, pair_costs
from regionframe.jobs.permutation import ALPHA, SEEDS, _split, alpha_allowed, permuted_t2, with_p
from regionframe.jobs.regress import permutation_map
from regionframe.jobs.trees import last_logf, model_of, null_max, rising, scored
from regionframe.operators.agglomerate import RegressionSums, TwoGroupsOf, agglomerate, merge_rounds, six_neighbours, trees
from regionframe.operators.clusters import grown_mask, min_variance_mask, tfce
from regionframe.operators.permute import labelled
from regionframe.operators.regression import subjects
from regionframe.operators.tree import greedy_cut
from regionframe.sources.cube import CUBE2_SQL, cube1, cube2
from regionframe.sources.cut import cut

QUERIES, ORACLES = {}, {}


def leaves(spark, sf_dir, seeds: int) -> DataFrame:
    """(perm, node, i, j, k, n0, s0, q0, n1, s1, q1): every permutation's voxels from one grouping of the cube."""
    c = cube1(spark, sf_dir).drop("grp", "label").join(labelled(_split(spark, sf_dir), seeds), "sbj")
    c = c.select(F.col("pos").alias("node"), "i", "j", "k", "x", F.posexplode("labels").alias("perm", "grp"))
    x = lambda g, v: F.when(F.col("grp") == g, v)
    aggs = [f.alias(f"{n}{g}") for g in (0, 1) for n, f in (("n", F.count(x(g, F.col("x")))), ("s", F.sum(x(g, F.col("x")))), ("q", F.sum(x(g, F.col("x") * F.col("x")))))]
    return c.groupBy("perm", "node", "i", "j", "k").agg(*aggs)


def agglomerate_tree(spark, sf_dir):
    t = trees(leaves(spark, sf_dir, 0))
    return t.select("node", "parent", "size", F.round("stat", 5).alias("stat"), F.round("cost", 8).alias("cost"))


QUERIES["agglomerate_tree"] = agglomerate_tree


def agglomerate_invariants(spark, sf_dir):
    """Of every permutation's tree: nodes, roots, the root's size, children whose number is not below their parent's."""
    t = trees(leaves(spark, sf_dir, 5))
    return t.groupBy("perm").agg(F.count("*").alias("nodes"), F.count_if(F.col("parent").isNull()).alias("roots"), F.max("size").alias("root_size"), F.count_if(F.col("parent") <= F.col("node")).alias("bad"))


QUERIES["agglomerate_invariants"] = agglomerate_invariants
ORACLES["agglomerate_invariants"] = "with v as (select max(len(embedding)) as v from embeddings) select cast(p as int) as perm, 2 * v - 1 as nodes, cast(1 as bigint) as roots, cast(v as bigint) as root_size, cast(0 as bigint) as bad from v, unnest(range(0, 6)) r(p)"


def agglomerate_d2(spark, sf_dir):
    """The observed split's tree of two features, by the determinant of the pooled covariance."""
    x = lambda g, v: F.when(F.col("grp") == g, v)
    terms = [("n", F.lit(1.0)), *[(f"s{a}", F.col(f"x{a}")) for a in (0, 1)], *[(f"q{a}{b}", F.col(f"x{a}") * F.col(f"x{b}")) for a in (0, 1) for b in (0, 1)]]
    aggs = [F.sum(x(g, v)).alias(f"{n}_{g}") for g in (0, 1) for n, v in terms]
    moments = cube2(spark, sf_dir).groupBy(F.lit(0).alias("perm"), F.col("pos").alias("node"), "i", "j", "k").agg(*aggs)
    return trees(moments, TwoGroupsOf(2), [f"{n}_{g}" for g in (0, 1) for n, _ in terms])


def agglomerate_d2_leaves(spark, sf_dir):
    """Its leaves' and root's statistics, which do not depend on the order of merges."""
    t = agglomerate_d2(spark, sf_dir)
    return t.where("size = 1 or parent is null").select("node", "size", F.round("stat", 5).alias("t2"))


QUERIES["agglomerate_d2"] = lambda spark, sf_dir: agglomerate_d2(spark, sf_dir).select("node", "parent", "size", F.round("stat", 5).alias("t2"), F.round("f", 5).alias("f"), F.round("cost", 10).alias("cost"))
QUERIES["agglomerate_d2_leaves"] = agglomerate_d2_leaves
_D2 = ", ".join(f"count(*) filter (grp = {g}) as n{g}, avg(x0) filter (grp = {g}) as a{g}, avg(x1) filter (grp = {g}) as b{g}, var_pop(x0) filter (grp = {g}) as aa{g}, var_pop(x1) filter (grp = {g}) as bb{g}, covar_pop(x0, x1) filter (grp = {g}) as ab{g}" for g in (0, 1))
ORACLES["agglomerate_d2_leaves"] = f"""with {CUBE2_SQL}, m as (select pos as node, cast(1 as bigint) as size, {_D2} from cube2 group by pos union all select 62, 32, {_D2} from cube2),
p as (select *, (n0 * aa0 + n1 * aa1) / (n0 + n1) as aa, (n0 * bb0 + n1 * bb1) / (n0 + n1) as bb, (n0 * ab0 + n1 * ab1) / (n0 + n1) as ab, a1 - a0 as a, b1 - b0 as b from m)
select node, size, round((a * a * bb - 2 * a * b * ab + b * b * aa) / (aa * bb - ab * ab) * n0 * n1 / (n0 + n1), 5) as t2 from p"""


def inference(all_trees: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(node, parent, size, f, saf, kept, significant) of the observed tree, from every permutation's: the null is computed
    once and gives both the size model and the threshold."""
    alpha_allowed(alpha, SEEDS)
    s = cut(all_trees.select("perm", "node", "parent", "size", "f"))
    saf = cut(scored(s, model_of(rising(last_logf(s)))))
    limit = null_max(saf).agg(F.percentile("top", F.lit(1 - alpha)).alias("limit"))
    mine = saf.where("perm = 0")
    kept = greedy_cut(mine.select("perm", "node", "parent", F.round("saf", 9).alias("saf")), "saf").select("node", F.lit(True).alias("kept"))
    out = mine.join(kept, "node", "left").crossJoin(F.broadcast(limit)).withColumn("kept", F.coalesce("kept", F.lit(False)))
    return out.select("node", "parent", "size", F.round("f", 5).alias("f"), F.round("saf", 5).alias("saf"), "kept", (F.col("kept") & F.coalesce(F.col("saf") >= F.col("limit"), F.lit(False))).alias("significant"))


QUERIES["region_discrim"] = lambda spark, sf_dir: inference(trees(leaves(spark, sf_dir, SEEDS)))


def regression_sums(spark, sf_dir, seeds: int, voxels: int) -> DataFrame:
    """(perm, a, b, v): sums over all subjects. perm -1 has those of products of two columns, voxels first, then the bias
    and the covariate; perm p has voxel a's sums with the covariate as permutation p deals it. A task adds up its
    subjects, so what it holds follows the grid."""
    x = subjects(spark, sf_dir).groupBy("sbj").agg(F.min("x").alias("x"))
    moved = permutation_map(x, seeds).join(x, "sbj").select(F.col("taken").alias("sbj"), "seed", "x").unionByName(x.select("sbj", F.lit(0).cast("long").alias("seed"), "x"))
    moved = moved.groupBy("sbj").agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", "x"))), lambda m: m["x"]).alias("xs"))
    y = cube1(spark, sf_dir).groupBy("sbj", "pos").agg(F.avg("x").alias("y")).groupBy("sbj").agg(F.collect_list(F.struct("pos", "y")).alias("ys"))

    def added(batches):
        products, with_x = np.zeros((voxels + 2, voxels + 2)), np.zeros((seeds + 1, voxels))
        for t in batches:
            at, ys = pc.list_parent_indices(t["ys"]).to_numpy(), t["ys"].flatten()
            z = np.ones((len(t), voxels + 2))
            z[:, :voxels] = 0
            z[at, ys.field("pos").to_numpy()] = ys.field("y").to_numpy(zero_copy_only=False)
            xs = t["xs"].flatten().to_numpy(zero_copy_only=False).reshape(len(t), seeds + 1)
            z[:, -1] = xs[:, 0]
            products += z.T @ z
            with_x += xs.T @ z[:, :voxels]
        for perm, m in ((-1, products), *((p, m[:, None]) for p, m in enumerate(with_x))):
            i, j = np.indices(m.shape, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, perm, np.int32)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], names=["perm", "a", "b", "v"])

    return y.join(moved, "sbj").select("ys", "xs").mapInArrow(added, "perm int, a int, b int, v double").groupBy("perm", "a", "b").agg(F.sum("v").alias("v"))


def regression_trees(spark, sf_dir, seeds: int) -> DataFrame:
    """The merge trees of the regression on bias and covariate by the greedy rule: one permutation a task, from sums over every
    subject. A task holds voxels x voxels cross sums, whatever the number of subjects; jobs/rounds.py has the form that
    holds none."""
    voxels = (cube1(spark, sf_dir).agg(F.max("pos")).first()[0] or 0) + 1
    sums = cut(regression_sums(spark, sf_dir, seeds, voxels))
    places = cube1(spark, sf_dir).select(F.col("pos").alias("a"), "i", "j", "k").distinct()
    own = sums.where("perm >= 0").join(places, "a", "left").select(F.col("perm").alias("deal"), F.col("a").alias("voxel"), F.col("v").alias("with_x"), "i", "j", "k")
    shared = sums.where("perm = -1").select("a", "b", "v").crossJoin(spark.range(seeds + 1).select(F.col("id").cast("int").alias("perm")))

    def one(key: tuple, f: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        f, products = f.sort_values("voxel"), np.zeros((voxels + 2, voxels + 2))
        products[p["a"], p["b"]] = p["v"]
        points = [(-2 * a - 2, 0, 0) if pd.isna(i) else (int(i), int(j), int(k)) for a, i, j, k in zip(f["voxel"], f["i"], f["j"], f["k"], strict=True)]
        objective = RegressionSums(products)
        rows = agglomerate(objective.leaves(f["with_x"].to_numpy(float)), six_neighbours(points), objective)
        out = pd.DataFrame(rows, columns=["node", "parent", "size", "stat", "f", "cost"])
        out["parent"] = out["parent"].astype("Int32")
        return out.assign(perm=int(key[0]))[["perm", "node", "parent", "size", "stat", "f", "cost"]]

    return own.groupBy("deal").cogroup(shared.groupBy("perm")).applyInPandas(one, "perm int, node int, parent int, size long, stat double, f double, cost double")


QUERIES["region_regress"] = lambda spark, sf_dir: inference(regression_trees(spark, sf_dir, SEEDS))


def merged_regions(spark, sf_dir, rounds: int = 4):
    """The distributed loop: each leaf's region after four rounds of mutually cheapest merges."""
    s = _leaf_stats(spark, sf_dir)
    columns = [c for c in s.columns if c not in ("node", "size")]
    return merge_rounds(s, neighbour_edges(spark, sf_dir), lambda st, e: pair_costs(st, e), rounds, columns)


QUERIES["merged_regions"] = merged_regions


def enhanced(images: DataFrame) -> DataFrame:
    """images (perm, i, j, k, t2) with tfce: one image a task."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["i", "j", "k"])
        return f.assign(tfce=tfce(list(zip(f["i"], f["j"], f["k"], strict=True)), f["t2"].to_numpy(float)))

    return images.select("perm", "i", "j", "k", "t2").groupBy("perm").applyInPandas(one, "perm int, i int, j int, k int, t2 double, tfce double")


def tfce_map(spark, sf_dir):
    """The observed voxels' enhanced t², and their family-wise p under the permutations' largest."""
    e = cut(enhanced(permuted_t2(spark, sf_dir)))
    null = e.where("perm > 0").groupBy("perm").agg(F.max("tfce").alias("top")).agg(F.collect_list("top").alias("tops"))
    return with_p(e.where("perm = 0").crossJoin(F.broadcast(null)), "tfce", "tops").select("i", "j", "k", F.round("t2", 6).alias("t2"), F.round("tfce", 4).alias("tfce"), "p")


QUERIES["tfce_map"] = tfce_map


def _sampled(spark, sf_dir, draws: int, num_vox: int, least_variance: bool):
    m = cube1(spark, sf_dir).groupBy("i", "j", "k").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    every = m.crossJoin(F.broadcast(spark.range(draws).select(F.col("id").cast("int").alias("draw"))))

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["i", "j", "k"]).reset_index(drop=True)
        r, points = np.random.default_rng(int(key[0])), list(zip(f["i"], f["j"], f["k"], strict=True))
        start = int(r.integers(len(f)))
        got = min_variance_mask(points, f[["n", "s", "q"]].to_numpy(float), start, num_vox) if least_variance else grown_mask(points, start, num_vox, r.permutation(len(f)))
        return f.loc[got, ["draw", "i", "j", "k"]]

    return every.groupBy("draw").applyInPandas(one, "draw int, i int, j int, k int")


QUERIES["sample_mask_cube"] = lambda spark, sf_dir: _sampled(spark, sf_dir, 8, 12, False)
QUERIES["sample_mask_min_var"] = lambda spark, sf_dir: _sampled(spark, sf_dir, 8, 12, True)
