"""Regression of image features on subjects' covariates, by sums: nothing but group sums leaves the scan.

Bias and one covariate, one image feature: the normal equations have a closed form. r² compares the uncentred error with
the centred variance, both plus the mean spatial variance of the regions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.functions.linalg import safe_div
from regionframe.sources.tables import table


def subjects(spark, sf_dir) -> DataFrame:
    """(sbj, x, z): target covariate and nuisance."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sbj"), F.col("label").cast("double").alias("x"), (F.col("vec_id") % 7).cast("double").alias("z"))


def fitted(y: DataFrame, x: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, n, b0, b1, r2, f for y (keys, sbj, y, spatial) on bias and x; size: voxels of a region."""
    s = y.join(x.select("sbj", "x"), "sbj").groupBy(*keys).agg(
        F.count("y").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.avg("spatial").alias("tp"),
    )
    c = {k: F.col(k) for k in ("n", "sx", "sy", "sxx", "sxy", "syy", "tp")}
    s = s.withColumn("b1", safe_div(c["n"] * c["sxy"] - c["sx"] * c["sy"], c["n"] * c["sxx"] - c["sx"] * c["sx"]))
    s = s.withColumn("b0", (c["sy"] - F.col("b1") * c["sx"]) / c["n"])
    mse = (c["syy"] - F.col("b0") * c["sy"] - F.col("b1") * c["sxy"]) / c["n"]
    var = c["syy"] / c["n"] - (c["sy"] / c["n"]) * (c["sy"] / c["n"])
    s = s.withColumn("r2", 1 - safe_div(mse + c["tp"], var + c["tp"]))
    return s.withColumn("f", safe_div(F.col("r2"), 1 - F.col("r2")) * (c["n"] * size - 2)).select(*keys, "n", "b0", "b1", "r2", "f")


def fit_sql(name: str, y: str, x: str, size: int = 1) -> str:
    """The oracle's fit, by the engine's own regression functions: a table `name` (key, n, b0, b1, r2, f)."""
    return f"""{name}_m as (select key, count(y) as n, regr_intercept(y, x) as b0, regr_slope(y, x) as b1, var_pop(y) as v, avg(spatial) as tp from {y} join {x} using (sbj) group by key),
{name}_e as (select key, avg((y - b0 - b1 * x) * (y - b0 - b1 * x)) as mse from {y} join {x} using (sbj) join {name}_m using (key) group by key),
{name} as (select key, n, b0, b1, 1 - (mse + tp) / (v + tp) as r2, (1 - (mse + tp) / (v + tp)) / ((mse + tp) / (v + tp)) * (n * {size} - 2) as f from {name}_m join {name}_e using (key))"""
