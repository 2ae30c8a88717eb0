"""Merge trees: rows (node, parent), a parent's number above its children's; null parents are roots (there may be many)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.sources.cut import cut


def ancestors(tree: DataFrame) -> DataFrame:
    """(node, ancestor) for all proper ancestors. Paths double each round, so rounds grow with the log of the depth."""
    up = cut(tree.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")))
    reach = 1
    while True:
        # paths of exactly `reach` steps, carried on by all paths known: lengths reach + 1 .. 2 * reach
        tips = up.where(F.col("steps") == reach)
        more = tips.join(up.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("steps").alias("on")), "ancestor")
        more = cut(more.select("node", F.col("above").alias("ancestor"), (F.col("steps") + F.col("on")).alias("steps")))
        if not more.head(1):
            return up.select("node", "ancestor")
        up, reach = cut(up.unionByName(more)), reach * 2


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, leaf): every node with the leaves below it, a leaf with itself."""
    leaves = tree.select("node").join(tree.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")
    above = ancestors(tree).join(leaves, "node").select("ancestor", F.col("node").alias("leaf"))
    return above.unionByName(leaves.select(F.col("node").alias("ancestor"), F.col("node").alias("leaf")))


def cover(nodes: list[tuple[int, int | None, float]], largest: bool = True) -> list[int]:
    """Greedy cut: nodes in order of their value (ties: smaller number first), each pick drops its ancestors and
    descendants. nodes: (node, parent, value). A node is free while no pick is above, below or at it: picks mark their
    path upward once, and a node is under a pick if its own path meets one."""
    parent = {n: p for n, p, _ in nodes}
    picked: set[int] = set()
    above: set[int] = set()
    out = []
    for n, _, _ in sorted(nodes, key=lambda x: (-x[2] if largest else x[2], x[0])):
        if n in above:
            continue
        path, at = [], n
        while at is not None and at not in picked:
            path.append(at)
            at = parent.get(at)
        if at is not None:
            continue
        picked.add(n)
        above.update(path[1:])
        out.append(n)
    return out


def greedy_cut(tree: DataFrame, value: str, largest: bool = True) -> DataFrame:
    """(perm, node): the greedy cut of each permutation's tree, one tree a task: rows (perm, node, parent, value). A null
    value is never picked."""

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        parents = [None if pd.isna(p) else int(p) for p in f["parent"]]
        last = float("-inf") if largest else float("inf")  # nulls come last, so they take nothing from others
        values = [last if v is None or v != v else v for v in f[value].tolist()]
        rows = list(zip(f["node"].astype(int).tolist(), parents, values, strict=True))
        known = {n for n, _, v in rows if v != last}
        got = [n for n in cover(rows, largest) if n in known]
        return pd.DataFrame({"perm": [int(key[0])] * len(got), "node": got})

    return tree.select("perm", "node", "parent", value).groupBy("perm").applyInPandas(one, "perm int, node int")
