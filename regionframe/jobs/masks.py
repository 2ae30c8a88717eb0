"""Queries on masks, point sets, affine spaces and morphology."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionframe.operators import grid as G
from regionframe.operators.components import connected
from regionframe.sources.cube import CUBE1_SQL, cube1
from regionframe.sources.masks import MASKS_SQL, SHAPE, STEPS_SQL, grid, mask_box, mask_pos

QUERIES, ORACLES = {}, {}
IJK = G.IJK


def mask_all_nonzero(spark, sf_dir):
    """Voxels where no subject's value is zero."""
    return cube1(spark, sf_dir).groupBy(*IJK).agg(F.bool_and(F.col("x") != 0).alias("all")).where("all").select(*IJK)


QUERIES["mask_all_nonzero"] = mask_all_nonzero
ORACLES["mask_all_nonzero"] = f"with {CUBE1_SQL} select i, j, k from cube1 group by i, j, k having bool_and(x <> 0)"


def mask_and_or_not(spark, sf_dir):
    a, b = mask_pos(spark, sf_dir).withColumn("a", F.lit(True)), mask_box(spark, sf_dir).withColumn("b", F.lit(True))
    g = grid(spark).join(a, IJK, "left").join(b, IJK, "left").select(*IJK, F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    return g.select(*IJK, (F.col("a") & F.col("b")).alias("both"), (F.col("a") | F.col("b")).alias("either"), (~F.col("a")).alias("not_pos"))


QUERIES["mask_and_or_not"] = mask_and_or_not
ORACLES["mask_and_or_not"] = f"""with {MASKS_SQL}
select g.i, g.j, g.k, (a.i is not null and b.i is not null) as both, (a.i is not null or b.i is not null) as either, (a.i is null) as not_pos
from grid g left join mask_pos a using (i, j, k) left join mask_box b using (i, j, k)"""


def mask_equal(spark, sf_dir):
    """Whether two masks hold the same voxels."""
    a, b = mask_pos(spark, sf_dir), mask_box(spark, sf_dir)

    def same(x, y, name):
        d = x.exceptAll(y).unionAll(y.exceptAll(x))
        return d.agg((F.count("*") == 0).alias("equal"), F.count("*").alias("differ")).select(F.lit(name).alias("which"), "equal", "differ")

    return same(a, b, "pos and box").unionAll(same(b, b, "box and box"))


QUERIES["mask_equal"] = mask_equal
ORACLES["mask_equal"] = f"""with {MASKS_SQL}, d as (select count(*) as n from mask_pos full join mask_box using (i, j, k) where mask_pos.i is null or mask_box.i is null)
select 'pos and box' as which, n = 0 as equal, n as differ from d union all select 'box and box', true, 0"""


def mask_len(spark, sf_dir):
    return mask_pos(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit("pos").alias("mask"), "n").unionAll(mask_box(spark, sf_dir).agg(F.count("*").alias("n")).select(F.lit("box").alias("mask"), "n"))


QUERIES["mask_len"] = mask_len
ORACLES["mask_len"] = f"with {MASKS_SQL} select 'pos' as mask, count(*) as n from mask_pos union all select 'box', count(*) from mask_box"

_SETS = {
    "union": (lambda a, b: a.union(b).distinct(), "select * from mask_pos union select * from mask_box"),
    "intersect": (lambda a, b: a.intersect(b), "select * from mask_pos intersect select * from mask_box"),
    "diff": (lambda a, b: a.subtract(b), "select * from mask_pos except select * from mask_box"),
    "symdiff": (lambda a, b: a.subtract(b).union(b.subtract(a)), "(select * from mask_pos except select * from mask_box) union all (select * from mask_box except select * from mask_pos)"),
}
for _name, (_set, _sql) in _SETS.items():
    QUERIES[f"pointcloud_{_name}"] = lambda spark, sf_dir, f=_set: f(mask_pos(spark, sf_dir), mask_box(spark, sf_dir))
    ORACLES[f"pointcloud_{_name}"] = f"with {MASKS_SQL} {_sql}"

#: A grid-to-world map with shear, and its use: rows of (i, j, k, 1).
AFFINE = ((2.0, 0.5, 0.0, -10.0), (0.0, 2.0, 0.0, 5.0), (0.0, 0.25, 3.0, 1.0))


def _to_world(p, m=AFFINE):
    return p.withColumns({f"{w}": sum((c * F.col(v) for c, v in zip(row[:3], IJK, strict=True)), F.lit(row[3])) for w, row in zip("xyz", m, strict=True)})


def _inverse(m=AFFINE):
    import numpy as np

    return [tuple(float(x) for x in r) for r in np.linalg.inv(np.vstack([m, (0, 0, 0, 1)]))[:3]]


def _from_world(p, m=AFFINE, whole=True):
    out = {v: sum((c * F.col(w) for c, w in zip(row[:3], "xyz", strict=True)), F.lit(row[3])) for v, row in zip(IJK, _inverse(m), strict=True)}
    return p.select(*[(F.rint(e).cast("int") if whole else F.round(e, 9)).alias(v) for v, e in out.items()])


_WORLD = "2.0 * i + 0.5 * j - 10 as x, 2.0 * j + 5 as y, 0.25 * j + 3.0 * k + 1 as z"
QUERIES["affine_to_world"] = lambda spark, sf_dir: _to_world(mask_pos(spark, sf_dir)).select(*IJK, *[F.round(c, 6).alias(c) for c in "xyz"])
ORACLES["affine_to_world"] = f"with {MASKS_SQL} select i, j, k, cast(2.0 * i + 0.5 * j - 10 as double) as x, cast(2.0 * j + 5 as double) as y, cast(0.25 * j + 3.0 * k + 1 as double) as z from mask_pos"
QUERIES["affine_round_trip"] = lambda spark, sf_dir: _from_world(_to_world(mask_pos(spark, sf_dir)))
ORACLES["affine_round_trip"] = f"with {MASKS_SQL} select i, j, k from mask_pos"
#: Half the voxel size of the identity grid.
HALF = ((0.5, 0.0, 0.0, 0.0), (0.0, 0.5, 0.0, 0.0), (0.0, 0.0, 0.5, 0.0))
ONE = ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0))
COARSE = ((2.0, 0.0, 0.0, 0.0), (0.0, 2.0, 0.0, 0.0), (0.0, 0.0, 2.0, 0.0))


def swap_ref(spark, sf_dir):
    """The points in a grid of half the voxel size, and in one of twice (rounded half to even, repeats dropped)."""
    p = _to_world(mask_pos(spark, sf_dir), ONE)
    return _from_world(p, HALF).distinct().select(F.lit("half").alias("ref"), *IJK).unionAll(_from_world(p, COARSE).distinct().select(F.lit("double").alias("ref"), *IJK))


QUERIES["swap_ref"] = swap_ref
ORACLES["swap_ref"] = f"""with {MASKS_SQL} select 'half' as ref, 2 * i as i, 2 * j as j, 2 * k as k from mask_pos
union all select distinct 'double', cast(round_even(i / 2, 0) as int), cast(round_even(j / 2, 0) as int), cast(round_even(k / 2, 0) as int) from mask_pos"""


def points_to_mask(spark, sf_dir):
    """World points back on the grid: what lies outside is left out, the rest counted by voxel."""
    p = _from_world(G.shifted(mask_pos(spark, sf_dir), [(2, 0, 0)]).transform(lambda d: _to_world(d, ONE)), ONE)
    g = p.withColumn("inside", (F.col("i") >= 0) & (F.col("i") < SHAPE[0]))
    return g.groupBy("inside").agg(F.count("*").alias("n"))


QUERIES["points_to_mask"] = points_to_mask
ORACLES["points_to_mask"] = f"with {MASKS_SQL} select i + 2 < 4 as inside, count(*) as n from mask_pos group by all"


def trim_bbox(spark, sf_dir):
    """The cube cut to the box around the mask, its origin moved there; both ends of the box are in it."""
    m = mask_box(spark, sf_dir).where("i > 0")
    box = m.agg(*[F.min(c).alias(f"lo_{c}") for c in IJK], *[F.max(c).alias(f"hi_{c}") for c in IJK])
    means = cube1(spark, sf_dir).groupBy(*IJK).agg(F.round(F.avg("x"), 6).alias("mean_x"))
    d = means.join(F.broadcast(box), (F.col("i").between(F.col("lo_i"), F.col("hi_i"))) & (F.col("j").between(F.col("lo_j"), F.col("hi_j"))) & (F.col("k").between(F.col("lo_k"), F.col("hi_k"))))
    return d.select(*[(F.col(c) - F.col(f"lo_{c}")).alias(c) for c in IJK], "mean_x")


QUERIES["trim_bbox"] = trim_bbox
ORACLES["trim_bbox"] = f"""with {MASKS_SQL}, b as (select min(i) as li, min(j) as lj, min(k) as lk, max(i) as hi, max(j) as hj, max(k) as hk from mask_box where i > 0),
m as (select i, j, k, round(avg(x), 6) as mean_x from cube1 group by i, j, k)
select i - li as i, j - lj as j, k - lk as k, mean_x from m, b where i between li and hi and j between lj and hj and k between lk and hk"""

_DILATED = "select distinct m.i + di as i, m.j + dj as j, m.k + dk as k from {m} m, steps where m.i + di between 0 and 3 and m.j + dj between 0 and 3 and m.k + dk between 0 and 3"
_SMALL = "small as (select i, j, k from mask_pos where i < 2 and j < 2)"
QUERIES["dilate_1"] = lambda spark, sf_dir: G.dilate(mask_pos(spark, sf_dir).where("i < 2 and j < 2"), 1, SHAPE)
ORACLES["dilate_1"] = f"with {MASKS_SQL}, {STEPS_SQL}, {_SMALL} {_DILATED.format(m='small')}"
QUERIES["dilate_2"] = lambda spark, sf_dir: G.dilate(mask_pos(spark, sf_dir).where("i < 2 and j < 2"), 2, SHAPE)
ORACLES["dilate_2"] = f"with {MASKS_SQL}, {STEPS_SQL}, {_SMALL}, one as ({_DILATED.format(m='small')}) {_DILATED.format(m='one')}"
QUERIES["erode_1"] = lambda spark, sf_dir: G.erode(mask_box(spark, sf_dir))
ORACLES["erode_1"] = f"with {MASKS_SQL}, {STEPS_SQL} select m.i, m.j, m.k from mask_box m, steps s join mask_box n on n.i = m.i + di and n.j = m.j + dj and n.k = m.k + dk group by all having count(*) = 7"


def edge_depth_scale(spark, sf_dir):
    """Depth in the mask by steps to the nearest grid voxel outside of it, softened: min(1, depth / 3). Beyond the grid
    does not count as outside."""
    m = mask_box(spark, sf_dir)
    out, depth = grid(spark).join(m, IJK, "left_anti"), m.withColumn("depth", F.lit(0))
    frontier = out
    for step in range(1, sum(SHAPE) + 1):
        frontier = G.inside(G.shifted(frontier, [(0, 0, 0), *G.SIX]), SHAPE).distinct()
        depth = depth.join(frontier.withColumn("near", F.lit(1)), IJK, "left").select(*IJK, F.when((F.col("depth") == 0) & F.col("near").isNotNull(), step).otherwise(F.col("depth")).alias("depth"))
        if step >= 3:
            break
    return depth.select(*IJK, F.round(F.when(F.col("depth") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("depth") / 3.0)), 6).alias("scale"))


QUERIES["edge_depth_scale"] = edge_depth_scale
ORACLES["edge_depth_scale"] = f"""with {MASKS_SQL}, outside as (select * from grid except select * from mask_box)
select m.i, m.j, m.k, round(least(1.0, min(abs(m.i - o.i) + abs(m.j - o.j) + abs(m.k - o.k)) / 3.0), 6) as scale from mask_box m, outside o group by all"""


def connected_components(spark, sf_dir):
    """Six-neighbour components of the mask; a component is named by its least voxel number."""
    v = mask_pos(spark, sf_dir).withColumn("node", F.col("i") * 16 + F.col("j") * 4 + F.col("k"))
    labels = connected(v.select("node"), G.edges(v))
    return v.join(labels, "node").select(*IJK, "label")


QUERIES["connected_components"] = connected_components
ORACLES["connected_components"] = f"""with recursive {MASKS_SQL}, {STEPS_SQL}, v as (select *, i * 16 + j * 4 + k as node from mask_pos),
e as (select a.node as a, b.node as b from v a, steps s join v b on b.i = a.i + di and b.j = a.j + dj and b.k = a.k + dk),
reach as (select a, b from e union select r.a, e.b from reach r join e on r.b = e.a)
select v.i, v.j, v.k, min(r.b) as label from v join reach r on v.node = r.a group by all"""
