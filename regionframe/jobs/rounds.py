"""Whole analyses on merge trees made in shared rounds, all permutations at once: two groups, and regression on a design."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.functions import dense
from regionframe.jobs.graph import neighbour_edges
from regionframe.jobs.inference import leaves
from regionframe.jobs.permutation import SEEDS
from regionframe.jobs.regress import permutation_map
from regionframe.operators.regression import subjects
from regionframe.operators.rounds import Sums, merge_trees, regression, two_groups
from regionframe.operators.tour import depths, leaves as tour_leaves, subtree_sums, tour
from regionframe.sources.cube import cube1

QUERIES, ORACLES = {}, {}
SUBJECTS_A_BLOCK = 256


def discrim_trees(spark, sf_dir, seeds: int) -> DataFrame:
    return merge_trees(leaves(spark, sf_dir, seeds), neighbour_edges(spark, sf_dir), two_groups())


def regression_leaves(images: DataFrame, designs: DataFrame, names: list[str]) -> DataFrame:
    """(perm, node, y0 .., s, q, ss) of voxels: images (sbj, node, y), designs (perm, sbj, and the columns named)."""
    k = len(names)
    every = designs.groupBy("sbj").agg(F.collect_list(F.struct("perm", dense.vector([F.col(c) for c in names]).alias("x"))).alias("xs"))
    rows = images.join(every, "sbj").select("node", "y", F.explode("xs").alias("x"))
    sums = [F.sum(F.get("x.x", F.lit(i)) * F.col("y")).alias(f"y{i}") for i in range(k)]
    m = rows.groupBy("x.perm", "node").agg(*sums, F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    return m.withColumn("ss", F.col("q"))


def subject_blocks(images: DataFrame) -> DataFrame:
    """(node, block, ys): each voxel's values in blocks of subjects, the same ones in the same order for all voxels; a value
    that is not there is 0."""
    every = images.select("sbj").distinct().crossJoin(images.select("node").distinct()).join(images, ["sbj", "node"], "left")
    block = F.floor(F.col("sbj") / SUBJECTS_A_BLOCK).cast("long").alias("block")
    return every.groupBy("node", block).agg(F.transform(F.array_sort(F.collect_list(F.struct("sbj", F.coalesce("y", F.lit(0.0)).alias("y")))), lambda v: v["y"]).alias("ys"))


def regress_sums(designs: DataFrame, names: list[str], contrast: list[bool]) -> Sums:
    """The rule for designs (sbj, and the columns named), one row a subject."""
    k = len(names)
    got = designs.agg(F.count("*"), *[F.sum(F.col(a).cast("double") * F.col(b)) for a in names for b in names]).first()
    return regression(got[0], [got[1 + i] or 0.0 for i in range(k * k)], contrast)


def regress_trees(spark, sf_dir, seeds: int) -> DataFrame:
    """Trees of the regression on bias and covariate, the covariate dealt anew under each seed."""
    x = subjects(spark, sf_dir).groupBy("sbj").agg(F.min("x").alias("x")).withColumn("one", F.lit(1.0))
    dealt = permutation_map(x, seeds).join(x.select(F.col("sbj").alias("taken"), "one", "x"), "taken").select(F.col("seed").cast("int").alias("perm"), "sbj", "one", "x")
    designs = x.select(F.lit(0).alias("perm"), "sbj", "one", "x").unionByName(dealt)
    images = cube1(spark, sf_dir).groupBy("sbj", F.col("pos").alias("node")).agg(F.avg("x").alias("y"))
    return merge_trees(regression_leaves(images, designs, ["one", "x"]), neighbour_edges(spark, sf_dir), regress_sums(x, ["one", "x"], [True, True]), subject_blocks(images))


def _invariants(trees: DataFrame) -> DataFrame:
    """Of every permutation's tree: nodes, roots, the root's size and leaves under it by its Euler tour, nodes whose size is not
    that of their leaves, children whose number is not below their parent's, leaves that are not at a depth."""
    t = tour(trees.select("perm", "node", "parent"), ["perm"])
    under = subtree_sums(t, tour_leaves(t).select("perm", "node", F.lit(1).cast("long").alias("below")), ["below"], ["perm"])
    d = trees.join(under, ["perm", "node"]).join(depths(t, ["perm"]), ["perm", "node"])
    bad = (F.col("size") != F.col("below")) | F.coalesce(F.col("parent") <= F.col("node"), F.lit(False)) | (F.col("parent").isNull() != (F.col("depth") == 0))
    return d.groupBy("perm").agg(F.count("*").alias("nodes"), F.count_if(F.col("parent").isNull()).alias("roots"), F.max("size").alias("root_size"), F.count_if(bad).alias("bad"))


def _invariants_sql(last: int) -> str:
    return f"with v as (select max(len(embedding)) as v from embeddings) select cast(p as int) as perm, 2 * v - 1 as nodes, cast(1 as bigint) as roots, cast(v as bigint) as root_size, cast(0 as bigint) as bad from v, unnest(range(0, {last + 1})) r(p)"


QUERIES["rounds_discrim_invariants"] = lambda spark, sf_dir: _invariants(discrim_trees(spark, sf_dir, SEEDS))
ORACLES["rounds_discrim_invariants"] = _invariants_sql(SEEDS)
QUERIES["rounds_regress_invariants"] = lambda spark, sf_dir: _invariants(regress_trees(spark, sf_dir, 3))
ORACLES["rounds_regress_invariants"] = _invariants_sql(3)
