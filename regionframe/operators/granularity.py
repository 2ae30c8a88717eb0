"""Regions of a merge tree at chosen numbers of regions: node lifetimes as intervals of merges, labels by the tree's tour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.operators.tour import leaves, outermost, tour


def spaced(most: int, volumes: int, least: int = 1) -> list[int]:
    """At most `volumes` different numbers from least to most, each about the same factor above the one before."""
    last = max(volumes - 1, 1)
    return sorted({round(least * (most / least) ** (n / last)) for n in range(volumes)}) if most >= least else []


def labels_at(tree: DataFrame, regions: list[int], voxels: int) -> DataFrame:
    """(t, leaf, label) of a tree (node, parent): at place t of `regions`, when so many regions are left, each leaf's region as its
    node's number and one.

    Leaves are numbered 0 to voxels - 1, the s-th merge of two makes node voxels - 1 + s; so a node is there from its own merge
    until its parent's, roots for ever. Numbers of regions that no merge leaves (above voxels, below the trees of a forest)
    show what is nearest: all leaves, or the roots. A tree without rows gives none.
    """
    steps = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(max(0, voxels - r)).cast("long").alias("step")) for t, r in enumerate(regions)])
    merge = lambda c: F.greatest(F.col(c).cast("long") - (voxels - 1), F.lit(0).cast("long"))
    alive = tree.select("node", F.explode(F.filter(steps, lambda s: (s["step"] >= merge("node")) & (F.col("parent").isNull() | (s["step"] < merge("parent"))))).alias("s")).select("s.t", "node")
    every = tour(tree).withColumn("t", F.explode(F.array(*[F.lit(t) for t in range(len(regions))])))
    top = outermost(every, alive, ["t"])
    return top.join(leaves(every).select("t", "node"), ["t", "node"]).select("t", F.col("node").alias("leaf"), (F.col("top") + 1).alias("label"))
