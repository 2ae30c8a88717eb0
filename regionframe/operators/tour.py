"""Euler tours of merge trees, so that a subtree is a range and its aggregates are differences of running sums.

A tour enters and leaves every node once: 2 V arcs in one list. A node's place is found by list ranking. Nodes with near
numbers share a house, leaves with their parents; a task follows a house's arcs to where they leave it, and only arcs at
which the list enters a house go on to pointer jumping: each round every such arc takes on what the arcs ahead of it know,
so that four times as much is known, and rounds grow with the log of their number whatever the tree's depth; no row is made
for a node and an ancestor. Running sums are taken in blocks of places:
within the blocks in all tasks, and over one row a block.

A tree is rows (keys, node, parent) of node numbers from 0 on; null parents are roots, there may be many, a tree for each
value of the keys. Children of a node follow by number, roots too. The children of one node are put in order by one task,
which spills; a merge tree's nodes have few.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionframe.sources.cut import Written

BLOCK = 4096
HOUSE = 1 << 17  # node numbers whose arcs one task follows at once


def ordered(tree: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, parent, child, sibling): each node's first child and the child or root that follows it."""
    t = tree.select(*keys, F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"))
    order = Window.partitionBy(*keys, "parent").orderBy("node")
    t = t.withColumns({"sibling": F.lead("node").over(order), "place": F.row_number().over(order)})
    child = t.where("parent is not null and place = 1").select(*keys, F.col("parent").alias("node"), F.col("node").alias("child"))
    return t.drop("place").join(child, [*keys, "node"], "left").select(*keys, "node", "parent", "child", "sibling")


def housed(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """nodes with `house`: HOUSE node numbers, those of leaves their parents', so that a list runs far within a house. Leaves
    of a house with too many of them are housed by their own numbers."""
    home = F.floor(F.when(F.col("child").isNull(), F.coalesce("parent", "node")).otherwise(F.col("node")) / HOUSE).cast("long")
    d = nodes.withColumn("home", home)
    full = d.groupBy(*keys, "home").agg(F.count("*").alias("held")).where(F.col("held") > 4 * HOUSE).drop("held")
    d = d.join(F.broadcast(full.withColumn("full", F.lit(True))), [*keys, "home"], "left")
    own = F.when(F.col("full") & F.col("child").isNull(), F.floor(F.col("node") / HOUSE).cast("long"))
    return d.withColumn("house", F.struct("home", own.alias("own"))).drop("home", "full")


def _followed(t: pa.Table) -> pa.Table:
    """For both arcs of a house's nodes: the steps to the first arc outside the house, and that arc; null at the list's end.
    Pointers double within the house."""
    node, parent, child, sibling = (t[c].combine_chunks().fill_null(-1).to_numpy() for c in ("node", "parent", "child", "sibling"))
    arc = np.concatenate([2 * node, 2 * node + 1])
    out = np.concatenate([np.where(child >= 0, 2 * child, 2 * node + 1), np.where(sibling >= 0, 2 * sibling, np.where(parent >= 0, 2 * parent + 1, -1))])
    order = np.argsort(arc)
    at = np.minimum(np.searchsorted(arc, out, sorter=order), len(arc) - 1)
    to, steps = np.where(arc[order[at]] == out, order[at], -1), (out >= 0).astype(np.int64)
    while len(inside := np.flatnonzero(to >= 0)):
        ahead = to[inside]
        more, then, there = steps[ahead], to[ahead], out[ahead]
        steps[inside] += more
        to[inside] = then
        out[inside] = there
    for name, part in (("enter", slice(0, len(node))), ("leave", slice(len(node), None))):
        t = t.append_column(f"{name}_steps", pa.array(steps[part])).append_column(f"{name}_out", pa.array(out[part], mask=out[part] < 0))
    return t.drop_columns(["child", "sibling", "house"])


def tour(tree: DataFrame, keys: Sequence[str] = (), written: Written | None = None) -> DataFrame:
    """(keys, node, parent, first, last): the places, from 0, at which the tour enters and leaves each node. Node u is in the
    subtree of v if first(v) <= first(u) <= last(v)."""
    written = written or Written(tree.sparkSession, "tour")
    keys = list(keys)
    nodes = housed(written(ordered(tree, keys), "ordered"), keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(*keys, "node", "parent").schema)
    local = written(nodes.groupBy(*keys, "house").applyInArrow(_followed, f"{kinds}, enter_steps long, enter_out long, leave_steps long, leave_out long"), "local")
    written.drop("ordered")
    sizes = written(local.groupBy(*keys).agg((2 * F.count("*")).alias("size")), "sizes")
    # Between houses the list is one of the arcs at which it enters a house
    outs = lambda: local.select(*keys, F.explode(F.array_distinct(F.array("enter_out", "leave_out"))).alias("arc")).where("arc is not null").distinct()
    heads = written(outs(), "outs").withColumns({"node": F.floor(F.col("arc") / 2).cast("long"), "odd": F.col("arc") % 2 == 1})
    pick = lambda c: F.when(F.col("odd"), F.col(f"leave_{c}")).otherwise(F.col(f"enter_{c}"))
    state = written(local.join(heads, [*keys, "node"]).select(*keys, "arc", pick("out").alias("next"), pick("steps").alias("steps")), "arcs")
    written.drop("outs")
    longest, known = state.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0, 1
    while known < longest:
        ahead = state
        for _ in range(3):  # an arc and the three that it sees one after another each know `known` arcs
            far = state.select(*keys, F.col("arc").alias("next"), F.col("next").alias("then"), F.col("steps").alias("more"))
            ahead = ahead.join(far, [*keys, "next"], "left").select(*keys, "arc", F.col("then").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        state = written(ahead, "arcs")
        written.only_last("arcs")
        known *= 4
    ranked = local.join(sizes, keys) if keys else local.crossJoin(sizes)
    for name, place in (("enter", "first"), ("leave", "last")):
        rest = state.select(*keys, F.col("arc").alias(f"{name}_out"), F.col("steps").alias("rest"))
        ranked = ranked.join(rest, [*keys, f"{name}_out"], "left").withColumn(place, F.col("size") - 1 - F.col(f"{name}_steps") - F.coalesce("rest", F.lit(0))).drop("rest")
    out = written(ranked.select(*keys, "node", "parent", "first", "last"), "tour")
    written.drop("arcs", "sizes", "local")
    return out


def places(toured: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, place, enters): both places of every node."""
    both = F.array(F.struct(F.col("first").alias("place"), F.lit(True).alias("enters")), F.struct(F.col("last").alias("place"), F.lit(False).alias("enters")))
    return toured.select(*keys, "node", F.explode(both).alias("p")).select(*keys, "node", "p.place", "p.enters")


def running(points: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """points (keys, place, columns, ...) with each column's running sum over the places up to this one, nulls as 0, in its
    stead."""
    keys = list(keys)
    points = points.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long"))
    totals = points.groupBy(*keys, "block").agg(*[F.sum(c).alias(f"{c}_total") for c in columns])
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    totals = totals.select(*keys, "block", *[F.sum(f"{c}_total").over(before).alias(f"{c}_before") for c in columns])
    within = Window.partitionBy(*keys, "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    local = points.withColumns({c: zero(F.sum(c).over(within)) for c in columns}).join(totals, [*keys, "block"])
    return local.withColumns({c: F.col(c) + zero(F.col(f"{c}_before")) for c in columns}).drop("block", *[f"{c}_before" for c in columns])


def subtree_sums(toured: DataFrame, values: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, columns): each column's sum over a node's subtree, itself included. values (keys, node, columns) has a row
    for some of the nodes, leaves or others, at most one each; nodes without one count as 0."""
    own = values.select(*keys, F.col("node").cast("long").alias("node"), F.lit(True).alias("enters"), *[F.col(c).alias(c) for c in columns])
    points = places(toured, keys).join(own, [*keys, "node", "enters"], "left")
    points = points.withColumns({f"{c}_own": F.coalesce(F.col(c), F.lit(0)) for c in columns})
    sums = running(points, keys, columns)
    at = lambda enters, c: F.max(F.when(F.col("enters") == enters, F.col(c)))
    return sums.groupBy(*keys, "node").agg(*[(at(False, c) - at(True, c) + at(True, f"{c}_own")).alias(c) for c in columns])


def _opened(toured: DataFrame, marked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """places with `mark` (whether the node is marked), `open` (marked nodes entered but not left, this one included) and
    `entered` (marked nodes entered so far)."""
    m = marked.select(*keys, F.col("node").cast("long").alias("node"), F.lit(True).alias("mark")).distinct()
    p = places(toured, keys).join(m, [*keys, "node"], "left").withColumn("mark", F.coalesce("mark", F.lit(False)))
    step: Column = F.when(F.col("mark"), F.when(F.col("enters"), 1).otherwise(-1)).otherwise(0).cast("long")
    return running(p.withColumns({"open": step, "entered": F.greatest(step, F.lit(0).cast("long"))}), keys, ["open", "entered"])


def marked_above(toured: DataFrame, marked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, above): how many proper ancestors of each node are among `marked` (keys, node)."""
    p = _opened(toured, marked, keys).where("enters")
    return p.select(*keys, "node", (F.col("open") - F.col("mark").cast("long")).alias("above"))


def outermost(toured: DataFrame, marked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, top): the highest marked node that is above or at each node; nodes without one are left out."""
    top = marked_above(toured, marked, keys).join(marked.select(*keys, F.col("node").cast("long").alias("node")).distinct(), [*keys, "node"]).where("above = 0").select(*keys, "node")
    p = _opened(toured, top, keys).where("enters and open > 0")
    names = p.where("mark").select(*keys, "entered", F.col("node").alias("top"))
    return p.select(*keys, "node", "entered").join(names, [*keys, "entered"]).select(*keys, "node", "top")


def roots(toured: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, root): the root of each node's tree; a root is its own."""
    return outermost(toured, toured.where("parent is null"), keys).withColumnRenamed("top", "root")


def depths(toured: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, depth): the number of a node's proper ancestors."""
    return marked_above(toured, toured, keys).withColumnRenamed("above", "depth")


def leaves(toured: DataFrame) -> DataFrame:
    """The nodes that the tour leaves as soon as it has entered them."""
    return toured.where("last = first + 1")
