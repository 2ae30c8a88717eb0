"""Merge trees of many permutations in shared rounds, without a kernel: what a task holds follows the partitions, not an image.

In each round every region's cheapest edge is found (costs to twelve digits, equal ones by the ends), edges that are cheapest
for both their ends merge, in all permutations at once; a permutation without an edge left makes no more rows, so it stops by
itself. This is a rule of its own: where a merge makes a neighbour cheaper, the greedy rule can choose otherwise.

A region made in round r has the number r * base + its least leaf, so numbers do not depend on partitions and a parent's is
above its children's. An edge's cost is formed anew only where an end was made anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionframe.functions import dense
from regionframe.sources.cut import Written

Get = Callable[[str], Column]


@dataclass(frozen=True)
class Sums:
    """What regions carry and how they are judged. columns add up when two regions merge, unless `merged` says otherwise; of()
    gives a region's worth from its columns, and a merge costs what the two regions' worths change; `cross` names a
    column of the edges that costs need; stats() gives (stat, f)."""

    columns: Sequence[str]
    worth: Callable[[Get], Column]
    stats: Callable[[Get], tuple[Column, Column]]
    rising: bool = False  # whether a larger worth is better: a merge then costs what it loses
    merged: Callable[[str, Get, Get, Column | None], Column] | None = None
    cross: str | None = None

    def joined(self, name: str, a: Get, b: Get, cross: Column | None) -> Column:
        special = self.merged(name, a, b, cross) if self.merged else None
        return special if special is not None else a(name) + b(name)

    def cost(self, a: Get, b: Get, cross: Column | None) -> Column:
        both = {c: self.joined(c, a, b, cross) for c in ("size", *self.columns)}
        change = self.worth(lambda c: both[c]) - self.worth(a) - self.worth(b)
        return -change if self.rising else change


def two_groups() -> Sums:
    """Two groups' moments of one feature: n0, s0, q0, n1, s1, q1. Worth: pooled variance times voxels; stat and F: t²."""

    def pooled(g: Get) -> Column:
        one = lambda k: F.coalesce(g(f"q{k}") - g(f"s{k}") * g(f"s{k}") / F.nullif(g(f"n{k}").cast("double"), F.lit(0.0)), F.lit(0.0))
        return (one(0) + one(1)) / (g("n0") + g("n1"))

    def stats(g: Get) -> tuple[Column, Column]:
        d = g("s1") / g("n1") - g("s0") / g("n0")
        t2 = F.try_divide(d * d, pooled(g)) * g("n0") * g("n1") / (g("n0") + g("n1"))
        return t2, t2

    return Sums(("n0", "s0", "q0", "n1", "s1", "q1"), lambda g: pooled(g) * g("size"), stats)


def regression(n: int, xtx: Sequence[float], contrast: Sequence[bool]) -> Sums:
    """Regression of regions' subject means on a design of k columns, the bias first, columns outside the contrast as nuisance.
    n and xtx are the subjects and the design's cross products (k * k), the same for all regions. Regions carry y0 .. (the
    sums of each design column times the subjects' sums), s and q (sums of values and of squares) and ss (the sum of the
    squares of subjects' sums); two regions' ss needs the edge's cross product of subjects' sums. Worth: r² times voxels.

    The design being the same, error and variance are yty less a quadratic form in y0 .. each, whose few numbers are formed
    here, with a pseudo-inverse: dependent columns share what they explain.
    """
    k, zero = len(contrast), F.lit(0.0)
    x = np.asarray(xtx, float).reshape(k, k)
    inverse = np.linalg.pinv(x, rcond=1e-12, hermitian=True)
    out = np.diag([0.0 if c else 1.0 for c in contrast])
    nuisance = out @ inverse  # y0 .. to the nuisances' coefficients
    taken = nuisance + nuisance.T - nuisance.T @ x @ nuisance
    shift = x[0] @ nuisance
    ys = [f"y{i}" for i in range(k)]

    def form(m: np.ndarray, g: Get) -> Column:
        return sum((float(m[i, j] if i == j else m[i, j] + m[j, i]) * g(ys[i]) * g(ys[j]) for i in range(k) for j in range(i, k) if m[i, j] or m[j, i]), zero)

    def r2(g: Get) -> Column:
        area = g("size").cast("double") * g("size") * n
        yty = g("ss") / area
        spatial = F.when(g("size") > 1, F.greatest(g("q") / g("size") / n - yty, zero)).otherwise(zero)
        mean = (g("s") - sum((float(c) * g(y) for c, y in zip(shift, ys, strict=True) if c), zero)) / g("size") / n
        error = F.greatest(yty - form(inverse, g) / area, zero) + spatial
        var = F.greatest(yty - form(taken, g) / area - mean * mean, zero) + spatial
        return F.when(var > 0, 1 - error / var)

    def stats(g: Get) -> tuple[Column, Column]:
        v = r2(g)
        return v, F.when(v < 1, v / (1 - v) * (n * g("size") - k) / max(1, k - 1))

    def merged(name: str, a: Get, b: Get, cross: Column | None) -> Column | None:
        return a(name) + b(name) + 2 * cross if name == "ss" else None

    return Sums((*ys, "s", "q", "ss"), lambda g: r2(g) * g("size"), stats, True, merged, "cross")


def _ends(edges: DataFrame, regions: DataFrame, columns: Sequence[str]) -> DataFrame:
    side = lambda k, end: regions.select("perm", F.col("node").alias(end), *[F.col(c).alias(f"{k}_{c}") for c in columns])
    return edges.join(side("a", "src"), ["perm", "src"]).join(side("b", "dst"), ["perm", "dst"])


def merge_trees(leaves: DataFrame, edges: DataFrame, sums: Sums, vectors: DataFrame | None = None) -> DataFrame:
    """(perm, node, parent, size, stat, f, cost, round): the merge trees of all permutations; forests where edges run out.

    leaves: (perm, node, and the columns of sums), one voxel each; edges: (src, dst) of leaves, the same in all
    permutations. Where costs need cross products, vectors (node, block, ys) has the leaves' subject sums in blocks.
    A cost that is null or NaN comes last. No leaf gives no row.
    """
    w = Written(leaves.sparkSession, "merge-trees")
    carried = ["size", *sums.columns]
    regions = leaves.select("perm", F.col("node").cast("long").alias("node"), F.col("node").cast("long").alias("low"), F.lit(1).cast("long").alias("size"), *sums.columns)
    regions = w(regions, "regions")
    base = (regions.agg(F.max("node")).first()[0] or 0) + 1
    perms = w(regions.select("perm").distinct(), "perms")
    long_edges = edges.select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).where("src <> dst").distinct()
    if sums.cross:
        blocks = w(vectors.select(F.col("node").cast("long").alias("node"), "block", "ys"), "blocks-of-leaves")
        long_edges = w(crossed(long_edges, blocks, []), "leaf-edges")
        blocks = w(perms.crossJoin(blocks), "blocks")
    first = lambda df: _costed(df, regions, sums)
    live = w(first(perms.crossJoin(long_edges)), "edges")
    judged = lambda df, cost, number: _judged(df, sums, cost).withColumn("round", F.lit(number))
    born, up, number = [judged(regions, F.lit(None).cast("double"), 0)], [], 0
    w.paths["leaves"] = w.paths.pop("regions")
    while live.head(1):
        number += 1
        e = F.struct(F.coalesce(F.nanvl(F.round("cost", 12), F.lit(float("inf"))), F.lit(float("inf"))).alias("rank"), "src", "dst", *(["cost", sums.cross] if sums.cross else ["cost"])).alias("e")
        best = live.select("perm", F.explode(F.array("src", "dst")).alias("node"), e).groupBy("perm", "node").agg(F.min("e").alias("e"))
        pairs = best.groupBy("perm", "e.src", "e.dst").agg(F.count("*").alias("n"), F.first("e").alias("e")).where("n = 2")
        pairs = pairs.select("perm", "src", "dst", "e.cost", *([f"e.{sums.cross}"] if sums.cross else []))
        both = _ends(pairs, regions, ["low", *carried])
        a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
        cross = F.col(sums.cross) if sums.cross else None
        made = both.select("perm", "src", "dst", "cost", (F.lit(number * base) + F.least("a_low", "b_low")).alias("node"), F.least("a_low", "b_low").alias("low"), *[sums.joined(c, a, b, cross).alias(c) for c in carried])
        made = w(made, "made")
        children = made.select("perm", F.explode(F.array("src", "dst")).alias("node"), F.col("node").alias("parent"))
        up.append(children)
        born.append(judged(made, F.col("cost"), number))
        regions = w(regions.join(children.select("perm", "node"), ["perm", "node"], "left_anti").unionByName(made.select("perm", "node", "low", *carried)), "regions")
        moved = lambda df, c: df.join(children.withColumnRenamed("node", c), ["perm", c], "left").withColumn(f"{c}_new", F.col("parent").isNotNull()).withColumn(c, F.coalesce("parent", c)).drop("parent")  # noqa: E731, B023
        after = moved(moved(live, "src"), "dst").where("src <> dst").withColumn("new", F.col("src_new") | F.col("dst_new"))
        old = after.where("not new").select(live.columns)
        new = after.where("new").select("perm", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        if sums.cross:
            gone = blocks.join(children, ["perm", "node"])
            joined = gone.groupBy("perm", F.col("parent").alias("node"), "block").agg(F.min(F.struct("node", "ys")).alias("a"), F.max(F.struct("node", "ys")).alias("b"))
            joined = joined.select("perm", "node", "block", F.zip_with("a.ys", "b.ys", lambda p, q: p + q).alias("ys"))
            blocks = w(blocks.join(children.select("perm", "node"), ["perm", "node"], "left_anti").unionByName(joined), "blocks")
            new = crossed(new, blocks, ["perm"])
        live = w(old.unionByName(_costed(new, regions, sums).select(live.columns)), "edges")
        for name in ("regions", "blocks", "edges"):
            w.only_last(name)
    nodes = reduce(DataFrame.unionByName, born)
    parents = reduce(DataFrame.unionByName, up) if up else nodes.select("perm", "node", F.lit(None).cast("long").alias("parent")).limit(0)
    tree = w(nodes.join(parents, ["perm", "node"], "left").select("perm", "node", "parent", "size", "stat", "f", "cost", "round"), "tree")
    w.drop("regions", "blocks", "edges", "blocks-of-leaves", "leaf-edges", "leaves", "made", "perms")
    return tree


def crossed(edges: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """edges (keys, src, dst) with `cross`, the sum over subjects of the products of both ends' sums."""
    of = lambda end: blocks.select(*keys, F.col("node").alias(end), "block", F.col("ys").alias(f"{end}_ys"))
    both = edges.join(of("src"), [*keys, "src"]).join(of("dst"), [*keys, "dst", "block"])
    return both.groupBy(*keys, "src", "dst").agg(F.sum(dense.dot(F.col("src_ys"), F.col("dst_ys"))).alias("cross"))


def _costed(edges: DataFrame, regions: DataFrame, sums: Sums) -> DataFrame:
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    both = _ends(edges, regions, ["size", *sums.columns])
    extra = [sums.cross] if sums.cross else []
    return both.select("perm", "src", "dst", *extra, sums.cost(a, b, F.col(sums.cross) if sums.cross else None).alias("cost"))


def _judged(regions: DataFrame, sums: Sums, cost: Column) -> DataFrame:
    stat, f = sums.stats(F.col)
    return regions.select("perm", "node", "size", stat.alias("stat"), f.alias("f"), cost.alias("cost"))
