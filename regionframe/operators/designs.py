"""Two-group statistics of any number of features, and regression on any design: sums first, then small solves by row.

Nothing but sums leaves the scan: a group's or region's moments, or the cross products X'X, X'y and y'y of k design columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionframe.functions import dense
from regionframe.functions.linalg import safe_div
from regionframe.operators.moments import pairs


def group_moments(cube: DataFrame, keys: Sequence[str], features: Sequence[str], group: str = "grp") -> DataFrame:
    """(keys, n0, mean0, cov0, n1, mean1, cov1) of two groups: arrays of the features' means and population covariances, from
    sums that merge by adding."""
    d, out = len(features), []
    for g in (0, 1):
        x = [F.when(F.col(group) == g, F.col(f).cast("double")) for f in features]
        out += [F.count(x[0]).alias(f"n{g}"), *[F.sum(v).alias(f"s{g}_{a}") for a, v in enumerate(x)], *[F.sum(x[a] * x[b]).alias(f"q{g}_{a}_{b}") for a, b in pairs(d)]]
    m = cube.groupBy(*keys).agg(*out)
    mean = lambda g, a: safe_div(F.col(f"s{g}_{a}"), F.col(f"n{g}"))
    cov = lambda g, a, b: safe_div(F.col(f"q{g}_{min(a, b)}_{max(a, b)}"), F.col(f"n{g}")) - mean(g, a) * mean(g, b)
    arrays = [c for g in (0, 1) for c in (F.col(f"n{g}"), dense.vector([mean(g, a) for a in range(d)]).alias(f"mean{g}"), dense.matrix([[cov(g, a, b) for b in range(d)] for a in range(d)]).alias(f"cov{g}"))]
    return m.select(*keys, *arrays)


def hotelling(moments: DataFrame, d: int) -> DataFrame:
    """moments with `rank`, `det` (of the pooled covariance), `t2` and `f`. Features that depend on those before them take no
    part: t² and F are those of the `rank` others, det is 0; all null if none is left or a group is empty."""
    n0, n1 = F.col("n0"), F.col("n1")
    pooled = F.zip_with("cov0", "cov1", lambda a, b: (n0 * a + n1 * b) / (n0 + n1))
    m = moments.withColumn("factor", dense.factor(pooled, d))
    m = m.withColumns({"rank": dense.rank(F.col("factor"), d), "det": dense.determinant(F.col("factor"), d)})
    m = m.withColumn("z", dense.forward(F.col("factor"), F.zip_with("mean1", "mean0", lambda a, b: a - b), d))
    t2 = F.when((F.col("rank") > 0) & (n0 > 0) & (n1 > 0), dense.dot(F.col("z"), F.col("z")) * n0 * n1 / (n0 + n1))
    m = m.withColumn("t2", t2)
    f = safe_div(F.col("t2") * (n0 + n1 - F.col("rank") - 1), (n0 + n1 - 2) * F.col("rank"))
    return m.withColumn("f", f).drop("factor", "z")


def products(rows: DataFrame, keys: Sequence[str], design: Sequence[str], y: str = "y") -> DataFrame:
    """(keys, n, xtx, xty, yty, sy): cross products of the design's columns and y over the rows of a key."""
    k = len(design)
    x, v = [F.col(c).cast("double") for c in design], F.col(y).cast("double")
    at = {p: F.sum(x[p[0]] * x[p[1]]).alias(f"x_{p[0]}_{p[1]}") for p in pairs(k)}
    s = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("sy"), F.sum(v * v).alias("yty"), *at.values(), *[F.sum(x[a] * v).alias(f"y_{a}") for a in range(k)])
    xtx = dense.matrix([[F.col(f"x_{min(a, b)}_{max(a, b)}") for b in range(k)] for a in range(k)])
    return s.select(*keys, "n", xtx.alias("xtx"), dense.vector([F.col(f"y_{a}") for a in range(k)]).alias("xty"), "yty", "sy")


def regressed(sums: DataFrame, contrast: Sequence[bool], spatial: Column | None = None, voxels: Column | None = None) -> DataFrame:
    """sums (n, xtx, xty, yty, sy) with `beta`, `r2` and `f`. Columns of the design that are not in the contrast are nuisance: what
    the whole fit gives to them is taken from y before its variance is formed. r² compares the error with that variance,
    both plus the regions' mean spatial variance. Design columns that depend on those before them get 0; r² is null
    where there is no variance. The bias, if any, is column 0 and in the contrast."""
    k = len(contrast)
    nuisance = [i for i in range(k) if not contrast[i]]
    spatial = F.lit(0.0) if spatial is None else spatial
    s = sums.withColumn("factor", dense.factor(F.col("xtx"), k))
    s = s.withColumn("beta", dense.solve(F.col("factor"), F.col("xty"), k))
    b = lambda i: F.get("beta", F.lit(i))
    xx, xy, n = lambda i, j: F.get("xtx", F.lit(i * k + j)), lambda i: F.get("xty", F.lit(i)), F.col("n")
    zero = F.lit(0.0)
    error = (F.col("yty") - dense.dot(F.col("beta"), F.col("xty"))) / n
    rest = F.col("yty") - 2 * sum((b(i) * xy(i) for i in nuisance), zero) + sum((b(i) * b(j) * xx(i, j) for i in nuisance for j in nuisance), zero)
    mean = (F.col("sy") - sum((b(i) * xx(0, i) for i in nuisance), zero)) / n
    var = rest / n - mean * mean
    r2 = F.when(var + spatial > 0, 1 - (F.greatest(error, zero) + spatial) / (var + spatial))
    s = s.withColumn("r2", r2)
    size = F.lit(1) if voxels is None else voxels
    return s.withColumn("f", safe_div(F.col("r2"), 1 - F.col("r2")) * (n * size - k) / max(1, k - 1)).drop("factor")
