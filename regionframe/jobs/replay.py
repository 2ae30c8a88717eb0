"""Merge trees on data: a node rebuilt, a tree replayed on other subjects, roots of a forest, batches of merges, eligible edges,
small labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.functions.linalg import safe_div, t2_one
from regionframe.jobs.graph import EDGES_SQL, _leaf_stats, neighbour_edges, pair_costs
from regionframe.jobs.trees import DYADIC_SQL, dyadic
from regionframe.operators.components import connected
from regionframe.operators.tree import ancestors, closure
from regionframe.sources.cube import CUBE1_SQL, CUBE2_SQL, cube1, cube2

QUERIES, ORACLES = {}, {}


def replayed(cube: DataFrame, below: DataFrame) -> DataFrame:
    """(node, n0, m0, v0, n1, m1, v1, t2) of nodes from data: below (ancestor, leaf) says which voxels (pos) a node has. One
    grouping over all nodes."""
    c = cube.select("pos", "grp", "x").join(below.select(F.col("leaf").alias("pos"), F.col("ancestor").alias("node")), "pos")
    x = lambda g: F.when(F.col("grp") == g, F.col("x"))
    m = c.groupBy("node").agg(*[f(x(g)).alias(f"{n}{g}") for g in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    return m.withColumn("t2", t2_one(*[F.col(n) for n in ("n0", "m0", "v0", "n1", "m1", "v1")]))


def replay_tree(spark, sf_dir):
    """The fixed tree on the subjects of odd number."""
    r = replayed(cube1(spark, sf_dir).where("sbj % 2 = 1"), closure(dyadic(spark, sf_dir).select("node", "parent")))
    return r.select("node", "n0", "n1", F.round("m0", 8).alias("m0"), F.round("m1", 8).alias("m1"), F.round("t2", 5).alias("t2"))


_G = ", ".join(f"count(x) filter (grp = {g}) as n{g}, avg(x) filter (grp = {g}) as m{g}, var_pop(x) filter (grp = {g}) as v{g}" for g in (0, 1))
_T2 = "(m1 - m0) * (m1 - m0) / nullif((n0 * v0 + n1 * v1) / (n0 + n1), 0) * n0 * n1 / (n0 + n1)"
QUERIES["replay_tree"] = replay_tree
ORACLES["replay_tree"] = f"""with {CUBE1_SQL}, {DYADIC_SQL}, r as (select ancestor as node, {_G} from closure join cube1 on leaf = pos where sbj % 2 = 1 group by all)
select node, n0, n1, round(m0, 8) as m0, round(m1, 8) as m1, round({_T2}, 5) as t2 from r"""


def node_rebuild(spark, sf_dir, node: int = 100):
    """One node's region from all data: its voxels' moments by group, and its statistic."""
    below = closure(dyadic(spark, sf_dir).select("node", "parent")).where(F.col("ancestor") == node)
    return replayed(cube1(spark, sf_dir), below).select("node", *[F.round(c, 8).alias(c) if c[0] != "n" else c for c in ("n0", "m0", "v0", "n1", "m1", "v1")], F.round("t2", 5).alias("t2"))


QUERIES["node_rebuild"] = node_rebuild
ORACLES["node_rebuild"] = f"""with {CUBE1_SQL}, {DYADIC_SQL}, r as (select ancestor as node, {_G} from closure join cube1 on leaf = pos where ancestor = 100 group by all)
select node, n0, round(m0, 8) as m0, round(v0, 8) as v0, n1, round(m1, 8) as m1, round(v1, 8) as v1, round({_T2}, 5) as t2 from r"""


def roots(tree: DataFrame) -> DataFrame:
    """(node, root): where each node's parents end; a root is its own."""
    top = tree.where("parent is null").select(F.col("node").alias("ancestor"))
    under = ancestors(tree).join(top, "ancestor").select("node", F.col("ancestor").alias("root"))
    return under.union(top.select(F.col("ancestor").alias("node"), F.col("ancestor").alias("root")))


def node_root(spark, sf_dir):
    """The roots of the forest that the fixed tree is after 56 merges."""
    t = dyadic(spark, sf_dir).where("node < 120").select("node", F.when(F.col("parent") < 120, F.col("parent")).alias("parent"))
    return roots(t)


QUERIES["node_root"] = node_root
ORACLES["node_root"] = f"""with {DYADIC_SQL}, a as (select x.ancestor as node, y.ancestor as above from closure x join closure y using (leaf) where y.ancestor >= x.ancestor and y.ancestor < 120 and x.ancestor < 120 group by all)
select node, max(above) as root from a group by all"""


def batch_merge(spark, sf_dir, share: float = 0.1):
    """One step that merges many: the cheapest edges, a share of the regions in number (equal costs by the ends), merge all that
    they connect. Each new region's least voxel, size, number of edges, and its groups' means."""
    s, edges = _leaf_stats(spark, sf_dir), neighbour_edges(spark, sf_dir)
    want = math.ceil(share * s.count())
    chosen = pair_costs(s, edges).orderBy(F.round("cost", 10), "src", "dst").limit(want)  # bounded by the number asked
    label = connected(s.select("node"), chosen)
    merged = s.join(label, "node").groupBy("label").agg(F.count("*").alias("size"), *[F.sum(c).alias(c) for c in ("n0", "s0", "n1", "s1")])
    per = chosen.join(label, F.col("src") == F.col("node")).groupBy("label").agg(F.count("*").alias("edges"))
    return merged.join(per, "label").select(F.col("label").alias("region"), "size", "edges", *[F.round(F.col(f"s{g}") / F.col(f"n{g}"), 8).alias(f"m{g}") for g in (0, 1)])


QUERIES["batch_merge"] = batch_merge
ORACLES["batch_merge"] = f"""with recursive {CUBE1_SQL}, {EDGES_SQL},
one as (select pos as node, count(x) filter (grp = 0) as n0, count(x) filter (grp = 1) as n1, var_pop(x) filter (grp = 0) as v0, var_pop(x) filter (grp = 1) as v1 from cube1 group by pos),
two as (select e.src, e.dst, count(x) filter (grp = 0) as n0, count(x) filter (grp = 1) as n1, var_pop(x) filter (grp = 0) as v0, var_pop(x) filter (grp = 1) as v1 from edges e join cube1 c on c.pos in (e.src, e.dst) group by all),
cost as (select t.src, t.dst, 2 * (t.n0 * t.v0 + t.n1 * t.v1) / (t.n0 + t.n1) - (a.n0 * a.v0 + a.n1 * a.v1) / (a.n0 + a.n1) - (b.n0 * b.v0 + b.n1 * b.v1) / (b.n0 + b.n1) as cost from two t join one a on a.node = t.src join one b on b.node = t.dst),
chosen as materialized (select src, dst from cost order by round(cost, 10), src, dst limit 7),
reach(a, b) as (select node, node from one union select r.a, case when c.src = r.b then c.dst else c.src end from reach r join chosen c on r.b in (c.src, c.dst)),
lab as (select a as node, min(b) as own from reach group by a),
per as (select own, count(*) as edges from chosen join lab on lab.node = chosen.src group by all)
select own as region, count(distinct pos) as size, any_value(edges) as edges, round(avg(x) filter (grp = 0), 8) as m0, round(avg(x) filter (grp = 1), 8) as m1 from cube1 join lab on lab.node = pos join per using (own) group by own"""


def eligible_edges(spark, sf_dir, least: int = 9):
    """Edges between regions of unequal sizes (voxels 0 to 31 in regions of eight, the others one region) of which the larger
    has fewer voxels than the limit."""
    region = F.when(F.col("pos") < 32, F.expr("pos div 8")).otherwise(4).cast("int")
    v = cube1(spark, sf_dir).select("pos", region.alias("region")).distinct()
    size = v.groupBy("region").agg(F.count("*").alias("size"))
    of = lambda k: v.join(size, "region").select(F.col("pos").alias(k), F.col("region").alias(f"{k}_region"), F.col("size").alias(f"{k}_size"))
    e = neighbour_edges(spark, sf_dir).join(of("src"), "src").join(of("dst"), "dst").where("src_region <> dst_region")
    e = e.where(F.greatest("src_size", "dst_size") < least)
    return e.select(F.least("src_region", "dst_region").alias("a"), F.greatest("src_region", "dst_region").alias("b")).distinct()


QUERIES["eligible_edges"] = eligible_edges
ORACLES["eligible_edges"] = f"""with {CUBE1_SQL}, {EDGES_SQL}, v as (select distinct pos, cast(case when pos < 32 then pos // 8 else 4 end as int) as region from cube1), s as (select region, count(*) as size from v group by all)
select distinct least(a.region, b.region) as a, greatest(a.region, b.region) as b from edges e join v a on a.pos = e.src join v b on b.pos = e.dst join s sa on sa.region = a.region join s sb on sb.region = b.region
where a.region <> b.region and greatest(sa.size, sb.size) < 9"""


def large_labels(spark, sf_dir, least: int = 8):
    """Labels of a segmentation (the root of the voxel's number, rounded down) with their voxels, the small ones left out."""
    v = cube1(spark, sf_dir).select("pos").distinct().select(F.floor(F.sqrt("pos")).cast("int").alias("label"))
    return v.groupBy("label").agg(F.count("*").alias("voxels")).where(F.col("voxels") >= least)


QUERIES["large_labels"] = large_labels
ORACLES["large_labels"] = f"with {CUBE1_SQL} select cast(floor(sqrt(pos)) as int) as label, count(distinct pos) as voxels from cube1 group by all having count(distinct pos) >= 8"


def regress_r2_d2(spark, sf_dir):
    """r² and F of two features together on bias and two covariates, by voxel: traces over the features, by the normal equations
    of centred moments."""
    c = cube2(spark, sf_dir).select("pos", "x0", "x1", F.col("label").cast("double").alias("x"), (F.col("sbj") % 7).cast("double").alias("z"))
    pairs = [("x", "x"), ("z", "z"), ("x", "z"), ("x", "x0"), ("z", "x0"), ("x", "x1"), ("z", "x1"), ("x0", "x0"), ("x1", "x1")]
    m = c.groupBy("pos").agg(F.count("*").alias("n"), *[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs])
    det = F.col("x_x") * F.col("z_z") - F.col("x_z") * F.col("x_z")
    for y in ("x0", "x1"):
        b = safe_div(F.col(f"x_{y}") * F.col("z_z") - F.col(f"z_{y}") * F.col("x_z"), det), safe_div(F.col(f"z_{y}") * F.col("x_x") - F.col(f"x_{y}") * F.col("x_z"), det)
        m = m.withColumn(f"fit_{y}", b[0] * F.col(f"x_{y}") + b[1] * F.col(f"z_{y}"))
    r2 = safe_div(F.col("fit_x0") + F.col("fit_x1"), F.col("x0_x0") + F.col("x1_x1"))
    return m.select("pos", F.round(r2, 8).alias("r2"), F.round(safe_div(r2, 1 - r2) * (F.col("n") - 3) / 2, 5).alias("f"))


QUERIES["regress_r2_d2"] = regress_r2_d2
ORACLES["regress_r2_d2"] = f"""with {CUBE2_SQL}, j as (select pos, x0, x1, cast(label as double) as x, cast(sbj % 7 as double) as z from cube2),
s as (select pos, count(*) as n, avg(x) as mx, avg(z) as mz, avg(x0) as m0, avg(x1) as m1, var_pop(x) as xx, var_pop(z) as zz, covar_pop(x, z) as xz, covar_pop(x, x0) as xa, covar_pop(z, x0) as za, covar_pop(x, x1) as xb, covar_pop(z, x1) as zb, var_pop(x0) + var_pop(x1) as v from j group by pos),
b as (select *, xx * zz - xz * xz as det from s),
e as (select j.pos, avg(power(x0 - m0 - (xa * zz - za * xz) / det * (x - mx) - (za * xx - xa * xz) / det * (z - mz), 2) + power(x1 - m1 - (xb * zz - zb * xz) / det * (x - mx) - (zb * xx - xb * xz) / det * (z - mz), 2)) as mse from j join b on b.pos = j.pos group by j.pos)
select pos, round(1 - mse / v, 8) as r2, round((1 - mse / v) / (mse / v) * (n - 3) / 2, 5) as f from b join e using (pos)"""
