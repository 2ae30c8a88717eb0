"""Label permutations that depend on the seed and the subject alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_digest() -> tuple[Column, list[Column]]:
    """The order of a seed's deal, as (slice, order): a slice is a range of the order that few subjects share."""
    digest = F.md5(F.concat_ws(":", "seed", "sbj"))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"), [digest, F.col("sbj")]


def by_number() -> tuple[Column, list[Column]]:
    """The subjects' own order, as (slice, order)."""
    return F.expr("sbj div 1000").cast("long"), [F.col("sbj")]


def ranked(df: DataFrame, keys: list[str], slice_of: Column, order: list[Column], name: str) -> DataFrame:
    """df with the rank, from 1, of each row among those of its keys. A task ranks one slice of the order; the slices before it
    count as a whole."""
    d = df.withColumn("slice", slice_of)
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    start = d.groupBy(*keys, "slice").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy(*keys, "slice").orderBy(*order))
    return d.withColumn("place", place).join(start, [*keys, "slice"]).withColumn(name, F.col("start") + F.col("place")).drop("slice", "place", "start")


def labelled(split: DataFrame, seeds: int) -> DataFrame:
    """(sbj, labels): labels[p] is the subject's group under permutation p of 1..seeds, labels[0] the given one.

    A permutation deals the groups' sizes anew in order of md5(seed:subject), so any engine and any partitioning deals
    alike.
    """
    zeros = split.agg(F.sum(1 - F.col("grp")).alias("zeros"))
    s = split.select("sbj").crossJoin(F.broadcast(split.sparkSession.range(1, seeds + 1).select(F.col("id").alias("seed"))))
    dealt = ranked(s, ["seed"], *by_digest(), "rank").crossJoin(F.broadcast(zeros)).select("seed", "sbj", (F.col("rank") > F.col("zeros")).cast("int").alias("grp"))
    every = dealt.unionByName(split.select(F.lit(0).cast("long").alias("seed"), "sbj", "grp"))
    return every.groupBy("sbj").agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", "grp"))), lambda x: x["grp"]).alias("labels"))
