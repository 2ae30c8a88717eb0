"""The masks that queries use, and their oracle forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.sources.cube import CUBE1_SQL, cube1

SHAPE = (4, 4, 4)


def grid(spark, shape=SHAPE) -> DataFrame:
    a, b, c = shape
    return spark.range(a * b * c).select(F.expr(f"cast(id div {b * c} as int)").alias("i"), F.expr(f"cast(id div {c} % {b} as int)").alias("j"), F.expr(f"cast(id % {c} as int)").alias("k"))


def mask_pos(spark, sf_dir) -> DataFrame:
    """Voxels whose mean over subjects is positive."""
    return cube1(spark, sf_dir).groupBy("i", "j", "k").agg(F.avg("x").alias("m")).where("m > 0").select("i", "j", "k")


def mask_box(spark, sf_dir) -> DataFrame:
    """The corner i < 3, j < 3 of the data's voxels."""
    return cube1(spark, sf_dir).where("i < 3 and j < 3").select("i", "j", "k").distinct()


GRID_SQL = "grid as (select cast(p // 16 as int) as i, cast(p // 4 % 4 as int) as j, cast(p % 4 as int) as k from unnest(range(0, 64)) r(p))"
MASKS_SQL = f"""{CUBE1_SQL}, {GRID_SQL},
mask_pos as (select i, j, k from cube1 group by i, j, k having avg(x) > 0),
mask_box as (select distinct i, j, k from cube1 where i < 3 and j < 3)"""
STEPS_SQL = "steps(di, dj, dk) as (values (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))"
