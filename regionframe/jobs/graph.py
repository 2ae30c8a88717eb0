"""Queries on images and the region adjacency graph: offsets, means, edges, merge costs, atlas merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from regionframe.functions.linalg import pooled
from regionframe.operators import grid as G
from regionframe.operators import moments as M
from regionframe.operators.regression import fit_sql, fitted, subjects
from regionframe.sources.cube import CUBE1_SQL, cube1
from regionframe.sources.masks import MASKS_SQL, mask_box, mask_pos

QUERIES, ORACLES = {}, {}
IJK = G.IJK


def voxels(spark, sf_dir):
    """(i, j, k, node): voxels numbered in order of their coordinates."""
    v = cube1(spark, sf_dir).select(*IJK).distinct()
    return v.select(*IJK, (F.col("i") * 16 + F.col("j") * 4 + F.col("k")).alias("node"))


def node_moments(spark, sf_dir):
    """Additive moments by voxel and group."""
    return cube1(spark, sf_dir).groupBy(F.col("pos").alias("node"), "grp").agg(*M.additive([F.col("x")]))


def neighbour_edges(spark, sf_dir):
    return G.edges(voxels(spark, sf_dir))


QUERIES["neighbour_edges"] = neighbour_edges
EDGES_SQL = """three(di, dj, dk) as (values (1, 0, 0), (0, 1, 0), (0, 0, 1)),
vox as (select distinct i, j, k, cast(i * 16 + j * 4 + k as int) as node from cube1),
edges as (select distinct least(a.node, b.node) as src, greatest(a.node, b.node) as dst from vox a, three join vox b on b.i = a.i + di and b.j = a.j + dj and b.k = a.k + dk)"""
ORACLES["neighbour_edges"] = f"with {CUBE1_SQL}, {EDGES_SQL} select src, dst from edges"


def pair_costs(stats, edges):
    """What merging the ends of each edge adds to the pooled variance times size; stats: one row a node with n0, s0, q0,
    n1, s1, q1 (groups 0 and 1) and size."""
    names = [f"{c}{g}" for g in (0, 1) for c in "nsq"] + ["size"]
    side = lambda p, key: stats.select(F.col("node").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in names])
    e = edges.join(side("a", "src"), "src").join(side("b", "dst"), "dst")

    def cost(get):
        var = lambda g: get(f"q{g}") / get(f"n{g}") - (get(f"s{g}") / get(f"n{g}")) * (get(f"s{g}") / get(f"n{g}"))
        return pooled(get("n0"), var(0), get("n1"), var(1)) * get("size")

    one = {p: cost(lambda c, p=p: F.col(f"{p}_{c}")) for p in "ab"}
    both = cost(lambda c: F.col(f"a_{c}") + F.col(f"b_{c}"))
    return e.select("src", "dst", (both - one["a"] - one["b"]).alias("cost"))


def _leaf_stats(spark, sf_dir):
    pick = lambda g, c: F.sum(F.when(F.col("grp") == g, F.col(c))).alias(f"{c[0]}{g}")
    return node_moments(spark, sf_dir).groupBy("node").agg(*[pick(g, c) for g in (0, 1) for c in ("n", "s0", "q00")], F.lit(1).alias("size"))


def edge_costs(spark, sf_dir):
    return pair_costs(_leaf_stats(spark, sf_dir), neighbour_edges(spark, sf_dir))


QUERIES["edge_cost_discrim"] = lambda spark, sf_dir: edge_costs(spark, sf_dir).select("src", "dst", F.round("cost", 8).alias("cost"))
COST_SQL = """lm as (select pos as node, grp, count(x) as n, sum(x) as s, sum(x * x) as q from cube1 group by all),
own as (select node, sum(n * (q / n - (s / n) * (s / n))) / sum(n) as c from lm group by node),
both_m as (select e.src, e.dst, m.grp, sum(m.n) as n, sum(m.s) as s, sum(m.q) as q from edges e join lm m on m.node in (e.src, e.dst) group by all),
both_c as (select src, dst, sum(n * (q / n - (s / n) * (s / n))) / sum(n) * 2 as c from both_m group by all),
costs as (select b.src, b.dst, b.c - x.c - y.c as cost from both_c b join own x on x.node = b.src join own y on y.node = b.dst)"""
ORACLES["edge_cost_discrim"] = f"with {CUBE1_SQL}, {EDGES_SQL}, {COST_SQL} select src, dst, round(cost, 8) as cost from costs"


def top_edges(spark, sf_dir):
    """The ten cheapest merges."""
    return edge_costs(spark, sf_dir).orderBy(F.round("cost", 10), "src", "dst").limit(10).select("src", "dst", F.round("cost", 8).alias("cost"))


QUERIES["top_edges"] = top_edges
ORACLES["top_edges"] = f"with {CUBE1_SQL}, {EDGES_SQL}, {COST_SQL} select src, dst, round(cost, 8) as cost from costs order by round(costs.cost, 10), src, dst limit 10"


def edge_cost_regress(spark, sf_dir):
    """What merging the ends of each edge takes from r² times size."""
    c = cube1(spark, sf_dir).select(F.col("pos").alias("node"), "sbj", "x")
    e = neighbour_edges(spark, sf_dir)
    x = subjects(spark, sf_dir)
    single = fitted(c.select("node", "sbj", F.col("x").alias("y"), F.lit(0.0).alias("spatial")), x, ["node"], 1).select("node", "r2")
    ends = e.select("src", "dst", F.explode(F.array("src", "dst")).alias("node"))
    pair = ends.join(c, "node").groupBy("src", "dst", "sbj").agg(F.avg("x").alias("y"), F.var_pop("x").alias("spatial"))
    both = fitted(pair, x, ["src", "dst"], 2).select("src", "dst", "r2")
    a, b = single.select(F.col("node").alias("src"), F.col("r2").alias("ra")), single.select(F.col("node").alias("dst"), F.col("r2").alias("rb"))
    return both.join(a, "src").join(b, "dst").select("src", "dst", F.round(F.col("ra") + F.col("rb") - 2 * F.col("r2"), 8).alias("cost"))


QUERIES["edge_cost_regress"] = edge_cost_regress
ORACLES["edge_cost_regress"] = f"""with {CUBE1_SQL}, {EDGES_SQL},
sy as (select pos as key, sbj, x as y, 0.0::double as spatial from cube1), sx as (select vec_id as sbj, cast(label as double) as x from embeddings),
{fit_sql("one", "sy", "sx")},
py as (select e.src * 1000 + e.dst as key, c.sbj, avg(c.x) as y, var_pop(c.x) as spatial from edges e join cube1 c on c.pos in (e.src, e.dst) group by all),
{fit_sql("two", "py", "sx")}
select e.src, e.dst, round(a.r2 + b.r2 - 2 * t.r2, 8) as cost from edges e join two t on t.key = e.src * 1000 + e.dst join one a on a.key = e.src join one b on b.key = e.dst"""


def merge_by_atlas(spark, sf_dir):
    """Regions of eight voxels by label, label 0 left out: their groups' moments."""
    atlas = voxels(spark, sf_dir).select("node", F.expr("node div 8").cast("int").alias("region")).where("region <> 0")
    s = node_moments(spark, sf_dir).join(atlas, "node")
    size = atlas.groupBy("region").agg(F.count("*").alias("size"))
    return M.derived(M.merge(s, ["region", "grp"], 1).join(size, "region"), ["region", "grp", "size"], 1, 8)


QUERIES["merge_by_atlas"] = merge_by_atlas
ORACLES["merge_by_atlas"] = f"with {CUBE1_SQL} select cast(pos // 8 as int) as region, grp, cast(8 as bigint) as size, count(x) as n, round(avg(x), 8) as mu0, round(var_pop(x), 8) as cov00 from cube1 where pos // 8 <> 0 group by all"


def atlas_missing(spark, sf_dir):
    """Atlas voxels, by label, that the mask does not have."""
    atlas = voxels(spark, sf_dir).select(*IJK, F.expr("node div 8").cast("int").alias("region"))
    return atlas.join(mask_pos(spark, sf_dir), IJK, "left_anti").groupBy("region").agg(F.count("*").alias("missing"))


QUERIES["atlas_missing"] = atlas_missing
ORACLES["atlas_missing"] = f"with {MASKS_SQL} select cast((i * 16 + j * 4 + k) // 8 as int) as region, count(*) as missing from (select i, j, k from grid except select * from mask_pos) group by all"


def region_disjoint(spark, sf_dir):
    """Voxels that more than one of two overlapping region sets claims."""
    m = mask_pos(spark, sf_dir).unionAll(mask_box(spark, sf_dir))
    return m.groupBy(*IJK).agg(F.count("*").alias("claims")).where("claims > 1")


QUERIES["region_disjoint"] = region_disjoint
ORACLES["region_disjoint"] = f"with {MASKS_SQL} select i, j, k, count(*) as claims from (select * from mask_pos union all select * from mask_box) group by all having count(*) > 1"


def paint_regions(spark, sf_dir):
    """Each voxel with its region's delta, 0 where no region is."""
    atlas = voxels(spark, sf_dir).select(*IJK, "node", F.expr("node div 8").cast("int").alias("region"))
    s = M.merge(node_moments(spark, sf_dir).join(atlas.select("node", "region").where("region <> 0"), "node"), ["region", "grp"], 1)
    delta = s.groupBy("region").agg((F.sum(F.when(F.col("grp") == 1, M.mean(0))) - F.sum(F.when(F.col("grp") == 0, M.mean(0)))).alias("delta"))
    return atlas.join(delta, "region", "left").select(*IJK, F.round(F.coalesce("delta", F.lit(0.0)), 8).alias("value"))


QUERIES["paint_regions"] = paint_regions
ORACLES["paint_regions"] = f"""with {CUBE1_SQL}, r as (select pos // 8 as region, avg(x) filter (grp = 1) - avg(x) filter (grp = 0) as d from cube1 where pos // 8 <> 0 group by all)
select distinct i, j, k, round(coalesce(d, 0), 8) as value from cube1 left join r on region = pos // 8"""


def offset_apply(spark, sf_dir):
    """0.1 more in the corner i, j, k < 2 for group 1: the voxels' group means after it."""
    c = cube1(spark, sf_dir)
    corner = mask_box(spark, sf_dir).where("i < 2 and j < 2 and k < 2").withColumn("off", F.lit(0.1))
    moved = c.join(corner, IJK, "left").withColumn("x", F.col("x") + F.when(F.col("grp") == 1, F.coalesce("off", F.lit(0.0))).otherwise(0.0))
    return moved.groupBy(*IJK, "grp").agg(F.round(F.avg("x"), 8).alias("mean_x"))


QUERIES["offset_apply"] = offset_apply
ORACLES["offset_apply"] = f"with {CUBE1_SQL} select i, j, k, grp, round(avg(x + case when grp = 1 and i < 2 and j < 2 and k < 2 then 0.1::double else 0 end), 8) as mean_x from cube1 group by all"


def offset_reset(spark, sf_dir):
    """Another offset in place of the first: raw values and offsets are kept apart, so nothing is undone."""
    c = cube1(spark, sf_dir)
    new = mask_pos(spark, sf_dir).withColumn("off", F.lit(10.0))
    return c.join(new, IJK, "left").groupBy(*IJK).agg(F.round(F.avg(F.col("x") + F.coalesce("off", F.lit(0.0))), 8).alias("mean_x"))


QUERIES["offset_reset"] = offset_reset
ORACLES["offset_reset"] = f"with {MASKS_SQL} select c.i, c.j, c.k, round(avg(x + case when m.i is null then 0 else 10 end), 8) as mean_x from cube1 c left join mask_pos m using (i, j, k) group by all"


def mean_image(spark, sf_dir):
    return cube1(spark, sf_dir).groupBy(*IJK).agg(F.round(F.avg("x"), 8).alias("mean_x"))


QUERIES["mean_image"] = mean_image
ORACLES["mean_image"] = f"with {CUBE1_SQL} select i, j, k, round(avg(x), 8) as mean_x from cube1 group by all"


def masked_cube(spark, sf_dir):
    """The cube with zeros outside the mask: sums by subject."""
    m = mask_box(spark, sf_dir).withColumn("inside", F.lit(True))
    return cube1(spark, sf_dir).join(m, IJK, "left").groupBy("sbj").agg(F.round(F.sum(F.when(F.col("inside"), F.col("x")).otherwise(0.0)), 6).alias("total"))


QUERIES["masked_cube"] = masked_cube
ORACLES["masked_cube"] = f"with {CUBE1_SQL} select sbj, round(sum(case when i < 3 and j < 3 then x else 0 end), 6) as total from cube1 group by all"


def subject_labels(spark, sf_dir):
    """Names for subjects in order: sbj and the number, padded to the width of the count."""
    ids = cube1(spark, sf_dir).select("sbj").distinct()
    n = ids.agg(F.count("*").alias("n"))
    # the rank of an id without one task for all: ids before its block, and its place in the block
    block = ids.withColumn("block", F.expr("sbj div 1000"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = block.groupBy("block").agg(F.count("*").alias("c")).withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    place = block.withColumn("at", F.row_number().over(Window.partitionBy("block").orderBy("sbj")) - 1).join(starts, "block")
    width = F.ceil(F.log10(F.col("n"))).cast("int")
    return place.crossJoin(F.broadcast(n)).select("sbj", F.concat(F.lit("sbj"), F.lpad((F.col("start") + F.col("at")).cast("string"), width, "0")).alias("name"))


QUERIES["subject_labels"] = subject_labels
ORACLES["subject_labels"] = "select vec_id as sbj, 'sbj' || lpad(cast(row_number() over (order by vec_id) - 1 as varchar), cast(ceil(log10((select count(*) from embeddings))) as int), '0') as name from embeddings"


def image_moments(spark, sf_dir):
    """Moments of all values of a group in a mask: each voxel of each subject is an observation."""
    c = cube1(spark, sf_dir).join(F.broadcast(mask_box(spark, sf_dir)), IJK, "left_semi")
    return M.derived(c.groupBy("grp").agg(*M.additive([F.col("x")])), ["grp"], 1, 8)


QUERIES["image_moments"] = image_moments
ORACLES["image_moments"] = f"with {CUBE1_SQL} select grp, count(x) as n, round(avg(x), 8) as mu0, round(var_pop(x), 8) as cov00 from cube1 where i < 3 and j < 3 group by all"
