"""The greedy cut of merge trees in rounds: nodes in order of their value, each pick drops its ancestors and descendants.

A node is picked in the first round in which it is better than every live node above and below it; what is above or below a
pick then dies with it. That gives the picks of the greedy order, all trees at once, in as many rounds as better nodes wait
for each other. What is above and below is found along pointers to the ancestors 1, 2, 4, 8 .. steps up, which are made
once: a row a node and pointer at most, so V log V, and a node's best below is gathered along the same pointers backwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionframe.sources.cut import Written


def pointers(tree: DataFrame, keys: Sequence[str], written: Written) -> list[DataFrame]:
    """For 1, 2, 4 .. steps: (keys, node, up), nodes that have such an ancestor."""
    out = [written(tree.where("parent is not null").select(*keys, F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("up")), "pointers")]
    while out[-1].head(1):
        last = out[-1]
        out.append(written(last.join(last.select(*keys, F.col("node").alias("up"), F.col("up").alias("further")), [*keys, "up"]).select(*keys, "node", F.col("further").alias("up")), "pointers"))
    return out[:-1]


def around(values: DataFrame, ups: list[DataFrame], keys: Sequence[str], written: Written) -> DataFrame:
    """values (keys, node, v, ...) with `above` and `below`, the least v among all proper ancestors and descendants."""
    keys = list(keys)
    state = values.withColumns({"above": F.lit(None).cast(values.schema["v"].dataType), "below": F.lit(None).cast(values.schema["v"].dataType)})
    for n, up in enumerate(ups):  # known: what is up to 2^n - 1 steps away
        near: Column = F.least("v", "above")
        far = state.select(*keys, F.col("node").alias("up"), near.alias("from_above"))
        over = up.join(far, [*keys, "up"]).select(*keys, "node", "from_above")
        under = up.join(state.select(*keys, "node", F.least("v", "below").alias("from_below")), [*keys, "node"]).groupBy(*keys, F.col("up").alias("node")).agg(F.min("from_below").alias("from_below"))
        state = state.join(over, [*keys, "node"], "left").join(under, [*keys, "node"], "left")
        state = state.withColumns({"above": F.least("above", "from_above"), "below": F.least("below", "from_below")}).drop("from_above", "from_below")
        state = written(state, "around")
        written.only_last("around")
    return state


def greedy_cut(tree: DataFrame, value: str, keys: Sequence[str] = ("perm",), largest: bool = True) -> DataFrame:
    """(keys, node): the greedy cut of every tree (keys, node, parent, value): disjoint nodes by falling value (rising, if not
    `largest`), equal values by the smaller number. Null and NaN values are never picked and take nothing from others."""
    keys, w = list(keys), Written(tree.sparkSession, "greedy-cut")
    worth = F.col(value).cast("double")
    ups = pointers(tree, keys, w)
    v = F.when(worth.isNotNull() & ~F.isnan(worth), F.struct((-worth if largest else worth).alias("worth"), F.col("node").cast("long").alias("own")))
    live = w(tree.select(*keys, F.col("node").cast("long").alias("node"), v.alias("v"), F.lit(False).alias("picked")), "live")
    while live.where("v is not null and not picked").head(1):
        seen = around(live.withColumn("v", F.when(~F.col("picked"), F.col("v"))), ups, keys, w)
        best = F.coalesce(F.col("v") < F.least("above", "below"), F.col("v").isNotNull() & F.col("above").isNull() & F.col("below").isNull())
        seen = w(seen.select(*keys, "node", "v", "picked", best.alias("new")), "seen")
        marks = around(seen.select(*keys, "node", F.when(F.col("new"), 1).alias("v"), F.col("v").alias("kept"), "picked", "new"), ups, keys, w)
        hit = F.coalesce("above", "below").isNotNull()
        live = w(marks.select(*keys, "node", F.when(~hit & ~F.col("new"), F.col("kept")).alias("v"), (F.col("picked") | F.col("new")).alias("picked")), "live")
        w.only_last("live")
        w.drop("seen")
    out = w(live.where("picked").select(*keys, "node"), "cut")
    w.drop("live", "pointers", "around")
    return out
