"""Voxel-wise two-group statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.functions.linalg import f_from_t2, pooled, safe_div, t2_one
from regionframe.sources.cube import CUBE1_SQL, CUBE2_SQL, cube1, cube2

QUERIES, ORACLES = {}, {}


def group_moments1(cube: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of x by group in one pass: n0, m0, v0, n1, m1, v1 for each key (partial aggregation before the shuffle)."""
    x = lambda g: F.when(F.col("grp") == g, F.col("x"))
    return cube.groupBy(*keys).agg(*[f(x(g)).alias(f"{n}{g}") for g in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])


def voxel_t2(spark, sf_dir):
    m = group_moments1(cube1(spark, sf_dir), ["i", "j", "k"])
    t2 = t2_one(*[F.col(c) for c in ("n0", "m0", "v0", "n1", "m1", "v1")])
    m = m.withColumn("t2", t2)
    return m.select("i", "j", "k", "n0", "n1", F.round(F.col("m1") - F.col("m0"), 8).alias("delta"), F.round("t2", 6).alias("t2"), F.round(f_from_t2(F.col("t2"), F.col("n0") + F.col("n1"), 1), 6).alias("f"))


QUERIES["voxel_t2"] = voxel_t2
VOXEL_T2_SQL = f"""{CUBE1_SQL},
voxel_m as (select i, j, k, pos, count(x) filter (grp = 0) as n0, avg(x) filter (grp = 0) as m0, var_pop(x) filter (grp = 0) as v0,
                   count(x) filter (grp = 1) as n1, avg(x) filter (grp = 1) as m1, var_pop(x) filter (grp = 1) as v1
            from cube1 group by i, j, k, pos),
voxel_s as (select *, (m1 - m0) * (m1 - m0) / nullif((n0 * v0 + n1 * v1) / (n0 + n1), 0) * n0 * n1 / (n0 + n1) as t2 from voxel_m)"""
ORACLES["voxel_t2"] = f"with {VOXEL_T2_SQL} select i, j, k, n0, n1, round(m1 - m0, 8) as delta, round(t2, 6) as t2, round(t2 * (n0 + n1 - 2) / (n0 + n1 - 2), 6) as f from voxel_s"


def voxel_t2_d2(spark, sf_dir):
    c = cube2(spark, sf_dir)
    x = lambda a, g: F.when(F.col("grp") == g, F.col(f"x{a}"))
    aggs = []
    for g in (0, 1):
        aggs += [F.count(x(0, g)).alias(f"n{g}"), F.avg(x(0, g)).alias(f"a{g}"), F.avg(x(1, g)).alias(f"b{g}"), F.var_pop(x(0, g)).alias(f"aa{g}"), F.var_pop(x(1, g)).alias(f"bb{g}"), F.covar_pop(x(0, g), x(1, g)).alias(f"ab{g}")]
    m = c.groupBy("i", "j", "k").agg(*aggs)
    p = {c: pooled(F.col("n0"), F.col(f"{c}0"), F.col("n1"), F.col(f"{c}1")) for c in ("aa", "bb", "ab")}
    d0, d1, n = F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0"), F.col("n0") + F.col("n1")
    det = p["aa"] * p["bb"] - p["ab"] * p["ab"]
    m = m.withColumn("t2", safe_div(p["bb"] * d0 * d0 - 2 * p["ab"] * d0 * d1 + p["aa"] * d1 * d1, det) * F.col("n0") * F.col("n1") / n)
    return m.select("i", "j", "k", F.round(det, 10).alias("det"), F.round("t2", 6).alias("t2"), F.round(f_from_t2(F.col("t2"), n, 2), 6).alias("f"))


QUERIES["voxel_t2_d2"] = voxel_t2_d2
ORACLES["voxel_t2_d2"] = f"""with {CUBE2_SQL},
m as (select i, j, k, {", ".join(f"count(x0) filter (grp = {g}) as n{g}, avg(x0) filter (grp = {g}) as a{g}, avg(x1) filter (grp = {g}) as b{g}, var_pop(x0) filter (grp = {g}) as aa{g}, var_pop(x1) filter (grp = {g}) as bb{g}, covar_pop(x0, x1) filter (grp = {g}) as ab{g}" for g in (0, 1))} from cube2 group by i, j, k),
p as (select *, n0 + n1 as n, a1 - a0 as d0, b1 - b0 as d1, (n0 * aa0 + n1 * aa1) / (n0 + n1) as aa, (n0 * bb0 + n1 * bb1) / (n0 + n1) as bb, (n0 * ab0 + n1 * ab1) / (n0 + n1) as ab from m),
s as (select *, aa * bb - ab * ab as det from p),
t as (select *, (bb * d0 * d0 - 2 * ab * d0 * d1 + aa * d1 * d1) / nullif(det, 0) * n0 * n1 / n as t2 from s)
select i, j, k, round(det, 10) as det, round(t2, 6) as t2, round(t2 * (n - 3) / ((n - 2) * 2), 6) as f from t"""
