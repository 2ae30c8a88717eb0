"""Greedy agglomeration of regions into a merge tree.

One run is sequential, so runs are what is parallel: each permutation's leaves are one group and one task. The kernel
holds additive moments only. merge_rounds() is the distributed form of one large run: rounds of mutually best merges.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.sources.cut import cut

TREE = "perm int, node int, parent int, size long, stat double, f double, cost double"


class TwoGroups:
    """Regions by two groups' moments of one feature: a row of (n0, s0, q0, n1, s1, q1). The cost of a merge is what it
    adds to pooled variance times voxels."""

    columns = ("n0", "s0", "q0", "n1", "s1", "q1")

    @staticmethod
    def _pooled(m: np.ndarray) -> float:
        return float(sum(m[3 * g + 2] - m[3 * g + 1] ** 2 / m[3 * g] for g in (0, 1) if m[3 * g]) / (m[0] + m[3]))

    def cost(self, a, b, na: int, nb: int) -> float:
        return self._pooled(a + b) * (na + nb) - self._pooled(a) * na - self._pooled(b) * nb

    def stat(self, m, size: int) -> tuple[float, float]:
        d, n = m[4] / m[3] - m[1] / m[0], m[0] + m[3]
        v = self._pooled(m)
        t2 = d * d / v * m[0] * m[3] / n if v > 0 else float("nan")
        return t2, t2


class TwoGroupsOf:
    """Regions by two groups' moments of d features: for each group n, the d sums, the d x d sums of products. The cost of a
    merge is what it adds to the determinant of the pooled covariance times voxels; the statistic is Hotelling's t² and F."""

    def __init__(self, d: int) -> None:
        self.d, self.width = d, 1 + d + d * d

    def _group(self, m: np.ndarray, g: int) -> tuple[float, np.ndarray, np.ndarray]:
        n, d = m[g * self.width], self.d
        mean = m[g * self.width + 1 :][:d] / n
        return n, mean, m[g * self.width + 1 + d :][: d * d].reshape(d, d) / n - np.outer(mean, mean)

    def _pooled(self, m: np.ndarray) -> np.ndarray:
        (n0, _, c0), (n1, _, c1) = self._group(m, 0), self._group(m, 1)
        return (n0 * c0 + n1 * c1) / (n0 + n1)

    def _det(self, m: np.ndarray) -> float:
        return float(np.linalg.det(self._pooled(m)))

    def cost(self, a, b, na: int, nb: int) -> float:
        return self._det(a + b) * (na + nb) - self._det(a) * na - self._det(b) * nb

    def stat(self, m, size: int) -> tuple[float, float]:
        (n0, m0, _), (n1, m1, _), d = self._group(m, 0), self._group(m, 1), self.d
        t2 = float((m1 - m0) @ np.linalg.pinv(self._pooled(m)) @ (m1 - m0)) * n0 * n1 / (n0 + n1)
        return t2, t2 * (n0 + n1 - d - 1) / ((n0 + n1 - 2) * d)


class Regression:
    """Regions by their subjects' sums (first half) and sums of squares (second half) of one feature. The statistic is r²
    of the subjects' means on a design; a merge costs what it takes from r² times voxels. `design` is S x k, with the
    columns of `nuisance` (boolean) taken out before r² is formed; `move` deals the means anew first: the subject
    whose mean each one takes, or an S x S matrix."""

    def __init__(self, design: np.ndarray, nuisance: np.ndarray | None = None, move: np.ndarray | None = None) -> None:
        self.x, self.w = design, np.linalg.pinv(design)
        self.nuisance = np.zeros(design.shape[1], bool) if nuisance is None else nuisance
        self.move = move

    def r2(self, m: np.ndarray, size: int) -> float:
        s, q = np.split(m, 2)
        mean = s / size
        spatial = float((q / size - mean * mean).mean())
        y = mean if self.move is None else mean[self.move] if self.move.ndim == 1 else self.move @ mean
        beta = self.w @ y
        rest = y - self.x[:, self.nuisance] @ beta[self.nuisance]
        error = rest - self.x[:, ~self.nuisance] @ beta[~self.nuisance]
        total = float(rest.var()) + spatial
        return 1 - (float((error**2).mean()) + spatial) / total if total > 0 else float("nan")

    def cost(self, a, b, na: int, nb: int) -> float:
        return -(self.r2(a + b, na + nb) * (na + nb) - self.r2(a, na) * na - self.r2(b, nb) * nb)

    def stat(self, m, size: int) -> tuple[float, float]:
        r2, (n, k) = self.r2(m, size), self.x.shape
        return r2, r2 / (1 - r2) * (n * size - k) / (k - 1) if r2 < 1 and k > 1 else float("nan")


class RegressionSums:
    """Regression on bias and one covariate from sums over subjects alone. `products` has the sums of products of two
    columns: the voxels, the bias, the covariate. A region's row adds up: the sum of its subjects' values, that with the
    covariate, the sum of squares, the cross sums with every voxel, and its voxels."""

    def __init__(self, products: np.ndarray) -> None:
        self.products, self.v = products, len(products) - 2
        self.n, self.sx, self.sxx = products[-2, -2], products[-2, -1], products[-1, -1]

    def leaves(self, with_x: np.ndarray) -> np.ndarray:
        cross = self.products[: self.v, : self.v]
        return np.column_stack([self.products[: self.v, -2], with_x, np.diag(cross), cross, np.eye(self.v)])

    def r2(self, m: np.ndarray, size: int) -> float:
        my, mx = m[0] / size / self.n, self.sx / self.n
        myy = float(m[3 : 3 + self.v] @ m[3 + self.v :]) / size**2 / self.n
        var, varx, cov = max(0.0, myy - my * my), self.sxx / self.n - mx * mx, m[1] / size / self.n - mx * my
        spatial = float(m[2]) / size / self.n - myy if size > 1 else 0.0
        error = max(0.0, var - (cov * cov / varx if varx > 1e-12 * (self.sxx / self.n) else 0.0))
        return 1 - (error + spatial) / (var + spatial) if var + spatial > 0 else float("nan")

    def cost(self, a, b, na: int, nb: int) -> float:
        return -(self.r2(a + b, na + nb) * (na + nb) - self.r2(a, na) * na - self.r2(b, nb) * nb)

    def stat(self, m, size: int) -> tuple[float, float]:
        r2 = self.r2(m, size)
        return r2, r2 / (1 - r2) * (self.n * size - 2) if r2 < 1 else float("nan")


def agglomerate(moments: np.ndarray, edges: list[tuple[int, int]], objective, stop: int = 1, largest: int | None = None, share: float | None = None) -> list[tuple]:
    """The merge tree over leaves 0..V-1 as rows (node, parent, size, stat, f, cost): cheapest edge first, equal costs by
    the ends' numbers. It ends at `stop` regions or without an edge, so it may be a forest. Edges whose larger end has
    `largest` voxels or more are left out. With `share` each step takes that part of the regions as its number of edges
    at once, and edges that meet merge together."""
    stats, size = list(moments), [1] * len(moments)
    parent, cost_of = [None] * len(stats), [float("nan")] * len(stats)
    near: list[set[int]] = [set() for _ in stats]
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    alive, heap = len(stats), []

    def push(a: int, b: int) -> None:
        a, b = min(a, b), max(a, b)
        if largest is None or max(size[a], size[b]) < largest:
            heap.append((objective.cost(stats[a], stats[b], size[a], size[b]), a, b))

    for a, b in sorted({(min(e), max(e)) for e in edges}):
        push(a, b)
    heapq.heapify(heap)
    while alive > stop and heap:
        want, picked = max(1, int(np.ceil(alive * share))) if share else 1, []
        while heap and len(picked) < want:
            e = heapq.heappop(heap)
            if parent[e[1]] is None and parent[e[2]] is None:
                picked.append(e)
        groups: list[tuple[set[int], float]] = []
        for c, a, b in picked:
            meet = [g for g in groups if a in g[0] or b in g[0]]
            groups = [g for g in groups if g not in meet] + [(set().union({a, b}, *[g[0] for g in meet]), min([c, *[g[1] for g in meet]]))]
        fresh = []
        for members, c in groups:
            new = len(stats)
            stats.append(sum(stats[m] for m in sorted(members)))
            size.append(sum(size[m] for m in members))
            parent.append(None)
            cost_of.append(c)
            around = set().union(*[near[m] for m in members]) - members
            near.append(around)
            for m in members:
                parent[m] = new
                near[m] = set()
            for x in around:
                near[x] = near[x] - members | {new}
            alive -= len(members) - 1
            fresh.append(new)
        for a, b in sorted({(min(n, x), max(n, x)) for n in fresh for x in near[n]}):
            before = len(heap)
            push(a, b)
            if len(heap) > before:
                heapq.heappush(heap, heap.pop())
    return [(i, parent[i], size[i], *objective.stat(stats[i], size[i]), cost_of[i]) for i in range(len(stats))]


def six_neighbours(points: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The edges between the places of voxels that touch."""
    at = {p: n for n, p in enumerate(points)}
    return [(n, m) for (i, j, k), n in at.items() for q in ((i + 1, j, k), (i, j + 1, k), (i, j, k + 1)) if (m := at.get(q)) is not None]


def trees(leaves: DataFrame, objective=None, columns: list[str] | None = None, **how) -> DataFrame:
    """The merge tree of each permutation; leaves: (perm, node, i, j, k, and the objective's columns), nodes numbered from 0 in every
    permutation. A task finds its voxels' neighbours by itself; what it holds follows the grid."""
    objective = objective or TwoGroups()
    columns = columns or list(objective.columns)

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node")
        edges = six_neighbours(list(zip(f["i"].tolist(), f["j"].tolist(), f["k"].tolist(), strict=True)))
        rows = agglomerate(f[columns].to_numpy(float), edges, objective, **how)
        out = pd.DataFrame(rows, columns=["node", "parent", "size", "stat", "f", "cost"])
        out["parent"] = out["parent"].astype("Int32")
        return out.assign(perm=int(key[0]))[["perm", "node", "parent", "size", "stat", "f", "cost"]]

    return leaves.select("perm", "node", "i", "j", "k", *columns).groupBy("perm").applyInPandas(one, TREE)


def merge_tree(stats: DataFrame, edges: DataFrame, costs, columns: list[str]) -> DataFrame:
    """(node, parent, size, cost, round): the merge tree of one large run without a kernel. In each round every region's
    cheapest edge is found (equal costs by the ends), edges that are cheapest for both their ends merge into new regions, and
    what is left is relabelled; it ends without an edge, so it may be a forest. stats: (node, size, columns); costs(stats,
    edges) adds `cost`. Each round joins on node numbers and is cut from the lineage before it."""
    stats, edges = cut(stats.withColumn("node", F.col("node").cast("long"))), cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")))
    born = [stats.select("node", F.col("size").cast("long").alias("size"), F.lit(None).cast("double").alias("cost"), F.lit(0).alias("round"))]
    up, first, number = [], (stats.agg(F.max("node")).first()[0] or 0) + 1, 0
    while True:
        number += 1
        ends = costs(stats, edges).select(F.explode(F.array("src", "dst")).alias("node"), F.struct(F.round("cost", 12).alias("cost"), "src", "dst").alias("e"))
        best = ends.groupBy("node").agg(F.min("e").alias("e"))
        pairs = best.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.*")
        pairs = cut(pairs.withColumn("parent", F.monotonically_increasing_id() + first))
        if (top := pairs.agg(F.max("parent")).first()[0]) is None:
            break
        first = top + 1
        children = pairs.select(F.explode(F.array("src", "dst")).alias("node"), "parent")
        moved = lambda df, c: df.join(children.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("parent", c)).drop("parent")  # noqa: E731, B023
        stats = cut(moved(stats, "node").groupBy("node").agg(F.sum("size").alias("size"), *[F.sum(x).alias(x) for x in columns]))
        made = stats.join(pairs.select(F.col("parent").alias("node"), "cost"), "node")
        born.append(made.select("node", F.col("size").cast("long").alias("size"), "cost", F.lit(number).alias("round")))
        up.append(children)
        e = moved(moved(edges, "src"), "dst").where("src <> dst")
        edges = cut(e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    parents = reduce(DataFrame.union, up) if up else born[0].select("node", F.lit(None).cast("long").alias("parent")).limit(0)
    return reduce(DataFrame.union, born).join(parents, "node", "left").select("node", "parent", "size", "cost", "round")


def merge_rounds(stats: DataFrame, edges: DataFrame, costs, rounds: int, columns: list[str]) -> DataFrame:
    """(leaf, region): one large run without a kernel. In each round every region's cheapest edge is found, edges that are
    cheapest for both their ends merge, and what is left is relabelled. stats: (node, size, columns); costs(stats, edges)
    adds `cost`. Each round joins on node numbers and is cut from the lineage before it."""
    stats, edges = cut(stats), cut(edges.select("src", "dst"))
    member = cut(stats.select(F.col("node").alias("leaf"), F.col("node").alias("region")))
    for _ in range(rounds):
        c = cut(costs(stats, edges))
        ends = c.select(F.explode(F.array("src", "dst")).alias("node"), F.struct(F.round("cost", 12).alias("cost"), "src", "dst").alias("e"))
        best = ends.groupBy("node").agg(F.min("e").alias("e"))
        pairs = best.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select(F.col("e.src").alias("into"), F.col("e.dst").alias("node"))
        pairs = cut(pairs)
        if not pairs.head(1):
            break
        moved = lambda df, c: df.join(pairs.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")  # noqa: E731, B023
        member = cut(moved(member, "region"))
        stats = cut(moved(stats, "node").groupBy("node").agg(F.sum("size").alias("size"), *[F.sum(x).alias(x) for x in columns]))
        e = moved(moved(edges, "src"), "dst").where("src <> dst")
        edges = cut(e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    return member
