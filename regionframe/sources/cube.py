"""Image cubes as long frames: one row per voxel and subject, derived from vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionframe.sources.tables import table


def cube1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4x4x4 grid, one feature: (sbj, label, pos, i, j, k, x, grp). grp is 1 for labels of 5 and more."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sbj"), "label", F.posexplode("embedding").alias("pos", "x"))
    return e.select(
        "sbj", "label", "pos",
        F.expr("cast(pos div 16 as int)").alias("i"), F.expr("cast(pos div 4 % 4 as int)").alias("j"), F.expr("cast(pos % 4 as int)").alias("k"),
        F.col("x").cast("double").alias("x"), (F.col("label") >= 5).cast("int").alias("grp"),
    )


def cube2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4x4x2 grid, two features: (sbj, label, pos, i, j, k, x0, x1, grp); the second is 32 places on."""
    e = table(spark, sf_dir, "embeddings")
    e = e.select(F.col("vec_id").alias("sbj"), "label", "embedding", F.posexplode(F.slice("embedding", 1, 32)).alias("pos", "x"))
    return e.select(
        "sbj", "label", "pos",
        F.expr("cast(pos div 8 as int)").alias("i"), F.expr("cast(pos div 2 % 4 as int)").alias("j"), F.expr("cast(pos % 2 as int)").alias("k"),
        F.col("x").cast("double").alias("x0"), F.element_at("embedding", F.col("pos") + 33).cast("double").alias("x1"),
        (F.col("label") >= 5).cast("int").alias("grp"),
    )


#: The same frames for the oracle.
CUBE1_SQL = """cube1 as (
  select vec_id as sbj, label, cast(p as int) as pos, cast(p // 16 as int) as i, cast(p // 4 % 4 as int) as j, cast(p % 4 as int) as k,
         cast(embedding[p + 1] as double) as x, case when label >= 5 then 1 else 0 end as grp
  from embeddings, unnest(range(0, 64)) r(p))"""
CUBE2_SQL = """cube2 as (
  select vec_id as sbj, label, cast(p as int) as pos, cast(p // 8 as int) as i, cast(p // 2 % 4 as int) as j, cast(p % 2 as int) as k,
         cast(embedding[p + 1] as double) as x0, cast(embedding[p + 33] as double) as x1, case when label >= 5 then 1 else 0 end as grp
  from embeddings, unnest(range(0, 32)) r(p))"""
