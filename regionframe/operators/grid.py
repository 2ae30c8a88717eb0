"""Point sets and masks on a grid: true voxels as rows (i, j, k), never dense arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IJK = ["i", "j", "k"]
#: The six neighbours of a voxel.
SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
#: One of each pair of directions: undirected six-neighbour edges.
THREE = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def shifted(points: DataFrame, offsets: list[tuple[int, int, int]], *carry: str) -> DataFrame:
    """Each point moved by each offset."""
    o = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(IJK, d, strict=True)]) for d in offsets]))
    return points.select(*IJK, *carry, o.alias("o")).select(*[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in IJK], *carry)


def inside(points: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    return points.where(reduce(lambda a, b: a & b, [(F.col(c) >= 0) & (F.col(c) < n) for c, n in zip(IJK, shape, strict=True)]))


def dilate(mask: DataFrame, times: int, shape: tuple[int, int, int]) -> DataFrame:
    """The mask and all within `times` steps of it, in the grid."""
    for _ in range(times):
        mask = inside(shifted(mask, [(0, 0, 0), *SIX]), shape).distinct()
    return mask


def erode(mask: DataFrame, times: int = 1) -> DataFrame:
    """Voxels all of whose six neighbours are in the mask; beyond the grid is outside of it."""
    for _ in range(times):
        votes = shifted(mask, [(0, 0, 0), *SIX]).groupBy(*IJK).agg(F.count("*").alias("n"))
        mask = votes.where("n = 7").select(*IJK)
    return mask


def edges(voxels: DataFrame, offsets: list[tuple[int, int, int]] = THREE) -> DataFrame:
    """(src, dst), src < dst, between voxels that an offset joins; voxels: (i, j, k, node). One equi-join."""
    moved = shifted(voxels.withColumnRenamed("node", "from"), offsets, "from")
    e = moved.join(voxels, IJK).where(F.col("from") != F.col("node"))
    return e.select(F.least("from", "node").alias("src"), F.greatest("from", "node").alias("dst")).distinct()
