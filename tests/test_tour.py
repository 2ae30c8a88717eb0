"""Euler tours against recursion on small trees, forests, chains and stars."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from regionframe.operators import tour as module
from regionframe.operators.tour import depths, leaves, marked_above, outermost, places, roots, subtree_sums, tour


def shapes():
    r = random.Random(1)
    out = {"one": [None], "chain": [*range(1, 60), None], "star": [40] * 40 + [None], "two": [None, None]}
    out["random"] = [p if (p := i + 1 + r.randrange(6)) < 90 else None for i in range(90)]
    return out


def brute(parent):
    children = {n: [c for c, p in enumerate(parent) if p == n] for n in range(len(parent))}
    place, out, at = {}, {}, 0

    def walk(n, top, depth):
        nonlocal at
        first, at = at, at + 1
        below = [x for c in children[n] for x in walk(c, top, depth + 1)]
        place[n], at = (first, at), at + 1
        out[n] = (sorted([n, *below]), top, depth)
        return [n, *below]

    for n in range(len(parent)):
        if parent[n] is None:
            walk(n, n, 0)
    return place, out


@pytest.mark.parametrize("block", [4096, 5])
def test_all_shapes_at_once(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    sys.setrecursionlimit(5000)
    s = shapes()
    rows = [(name, n, p) for name, parent in s.items() for n, p in enumerate(parent)]
    want = {name: brute(p) for name, p in s.items()}
    t = tour(spark.createDataFrame(rows, "tree string, node int, parent int"), ["tree"])
    assert {(r.tree, r.node): (r.first, r.last) for r in t.collect()} == {(k, n): v for k, (place, _) in want.items() for n, v in place.items()}
    assert {(r.tree, r.node) for r in leaves(t).collect()} == {(k, n) for k, (_, o) in want.items() for n, (below, _, _) in o.items() if below == [n]}
    assert {(r.tree, r.node): r.depth for r in depths(t, ["tree"]).collect()} == {(k, n): x[2] for k, (_, o) in want.items() for n, x in o.items()}
    assert {(r.tree, r.node): r.root for r in roots(t, ["tree"]).collect()} == {(k, n): x[1] for k, (_, o) in want.items() for n, x in o.items()}
    values = t.where("node % 3 <> 1").select("tree", "node", (F.col("node") * 10).alias("v"), F.lit(1).alias("c"))
    got = {(r.tree, r.node): (r.v, r.c) for r in subtree_sums(t, values, ["v", "c"], ["tree"]).collect()}
    assert got == {(k, n): (sum(10 * i for i in x[0] if i % 3 != 1), sum(i % 3 != 1 for i in x[0])) for k, (_, o) in want.items() for n, x in o.items()}
    marked = t.where("node % 4 = 2").select("tree", "node")
    above = {(k, n): [m for m, y in o.items() if m % 4 == 2 and n in y[0]] for k, (_, o) in want.items() for n in o}
    assert {(r.tree, r.node): r.above for r in marked_above(t, marked, ["tree"]).collect()} == {k: len([m for m in v if m != k[1]]) for k, v in above.items()}
    size = lambda k, m: len(want[k][1][m][0])
    assert {(r.tree, r.node): r.top for r in outermost(t, marked, ["tree"]).collect()} == {k: max(v, key=lambda m, k=k: size(k[0], m)) for k, v in above.items() if v}


def test_rows_follow_the_nodes(spark):
    """Two places a node and as many rounds as the logarithm to four of the places, however deep the tree is."""
    n = 3000
    deep = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") < n - 1, F.col("id") + 1).alias("parent"))
    t = tour(deep)
    assert places(t).count() == 2 * n
    assert t.where(f"first <> {n - 1} - node or last <> {n} + node").count() == 0


def test_nothing(spark):
    t = tour(spark.createDataFrame([], "node int, parent int"))
    assert t.count() == 0 and roots(t).count() == 0


@pytest.mark.parametrize("house", [1, 4, 13])
def test_lists_through_many_houses(spark, monkeypatch, house):
    monkeypatch.setattr(module, "HOUSE", house)
    s = shapes()
    rows = [(name, n, p) for name, parent in s.items() for n, p in enumerate(parent)]
    t = tour(spark.createDataFrame(rows, "tree string, node int, parent int").repartition(3), ["tree"])
    want = {(name, n): v for name, p in s.items() for n, v in brute(p)[0].items()}
    assert {(r.tree, r.node): (r.first, r.last) for r in t.collect()} == want


def test_pointer_jumping_takes_the_arcs_between_houses_alone(spark, monkeypatch):
    """A chain of merges, as deep as it is wide: rows of the rounds follow the houses, not the nodes."""
    rows, seen = module.Written.__call__, []

    def counted(self, df, name):
        out = rows(self, df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(module.Written, "__call__", counted)
    monkeypatch.setattr(module, "HOUSE", 500)
    n = 5000
    leaf = spark.range(n).select(F.col("id").alias("node"), (n + F.greatest(F.col("id") - 1, F.lit(0))).alias("parent"))
    inner = spark.range(n - 1).select((n + F.col("id")).alias("node"), F.when(F.col("id") < n - 2, n + F.col("id") + 1).alias("parent"))
    t = tour(leaf.union(inner))
    assert t.agg(F.count_distinct("first"), F.count_distinct("last"), F.max("last")).first()[:] == (2 * n - 1, 2 * n - 1, 4 * n - 3)
    assert max(k for name, k in seen if name == "arcs") <= 3 * n // 500
