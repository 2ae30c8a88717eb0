"""Approximate nearest neighbours by inner product: a forest of random-projection trees, one queue shared by all trees, and
exact scores of all candidates in the leaves it gives.

A tree has orthonormal random directions, one a level; a node splits at the median of its sampled vectors' projections.
A leaf's priority is the sum of the squared distances to the borders that lie between it and the query, a lower bound of
its squared distance. It never falls on the way down, and every node has a leaf of its own priority, so the queue, which
goes down all trees at once, holds no more nodes a level than leaves are wanted. How many leaves are wanted is measured:
some queries are compared with every vector, and as many leaves are visited as find `recall` of their neighbours.

Largest inner products become nearest vectors by one more component: every vector is filled up to the largest norm.

Equal vectors are one class, indexed once. Leaves make up cells of some thousand vectors; the vectors of a cell (in parts,
if there are more) and the queries that visit it (likewise) are one group, so a task holds no more than two parts. The
first tree's cells give each query a bound, below which the other trees' candidates are not handed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionframe.llm.shared import Stages, table

CELL, PART_QUERIES = 16384, 4096  # vectors and queries of a group, about
SAMPLE_BYTES = 32 << 20  # of the vectors that the trees are fitted on, at most
TRIALS = 256  # queries that the number of leaves is measured with, at most
_ROW = pa.schema([("id", pa.int64()), ("tree", pa.int32()), ("leaf", pa.int32())])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) in double precision. Vectors that are null, empty or zero or hold a null, NaN or infinite component take no
    part, nor do rows without an id."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    some = F.exists(x, lambda c: c != 0)
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: c.cast("double")).alias("v"))


def matrix(lists: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of `dims` components; missing ones are 0."""
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    m = np.zeros((len(lists), dims))
    if len(lists):
        ends = lists.offsets.to_numpy()
        sizes, flat = np.diff(ends), lists.values.to_numpy(zero_copy_only=False)
        m[np.repeat(np.arange(len(sizes)), sizes), np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)] = flat[ends[0] : ends[-1]]
    return m


@dataclass
class Forest:
    """The trees, and how vectors and queries are placed in them. Bounded by the sample, whatever the table holds."""

    dims: int
    unit: float  # the largest component; vectors are divided by it before norms are formed
    norm: float  # the largest norm then
    depth: int
    turns: np.ndarray  # trees x (dims + 1) x depth
    borders: list[list[np.ndarray]] = field(default_factory=list)  # tree, level -> a border a node

    def stored(self, v: np.ndarray) -> np.ndarray:
        v = v / self.unit
        return np.column_stack([v, np.sqrt(np.maximum(0.0, self.norm**2 - (v * v).sum(1)))])

    def asked(self, q: np.ndarray) -> np.ndarray:
        q = q / np.abs(q).max(1, keepdims=True)
        q = q / np.sqrt((q * q).sum(1, keepdims=True)) * self.norm
        return np.column_stack([q, np.zeros(len(q))])

    def fit(self, sample: np.ndarray) -> Forest:
        sample = self.stored(sample)
        for turn in self.turns:
            p, node, borders = sample @ turn, np.zeros(len(sample), np.int64), []
            for level in range(self.depth):
                order = np.lexsort((p[:, level], node))
                size = np.bincount(node, minlength=1 << level)
                middle = np.cumsum(size) - size + size // 2
                at = p[order, level]
                low, high = at[np.maximum(middle - 1, 0)], at[np.minimum(middle, len(at) - 1)]
                borders.append(np.where(size > 1, (low + high) / 2, 0.0))
                node = 2 * node + (p[:, level] > borders[level][node])
            self.borders.append(borders)
        return self

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """Each vector's leaf in each tree: rows x trees."""
        v, out = self.stored(v), np.zeros((len(v), len(self.turns)), np.int64)
        for t, turn in enumerate(self.turns):
            p = v @ turn
            for level in range(self.depth):
                out[:, t] = 2 * out[:, t] + (p[:, level] > self.borders[t][level][out[:, t]])
        return out

    def queue(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(priority, tree, leaf) of the `most` first leaves over all trees for each query, unsorted: rows x min(most, leaves).
        All trees are gone down together; what cannot be among the first `most` leaves leaves the queue on the way."""
        q, n, trees = self.asked(q), len(q), len(self.turns)
        side = np.stack([q @ turn for turn in self.turns])  # trees x rows x depth
        tree = np.tile(np.arange(trees), (n, 1))
        node, cost, rows = np.zeros((n, trees), np.int64), np.zeros((n, trees)), np.arange(n)[:, None]
        for level in range(self.depth):
            borders = np.stack([b[level] for b in self.borders])
            gap = side[tree, rows, level] - borders[tree, node]
            far = gap * gap
            cost = np.concatenate([cost + np.where(gap > 0, far, 0.0), cost + np.where(gap > 0, 0.0, far)], 1)
            node, tree = np.concatenate([2 * node, 2 * node + 1], 1), np.concatenate([tree, tree], 1)
            if cost.shape[1] > most:
                keep = np.argpartition(cost, most - 1, axis=1)[:, :most]
                cost, node, tree = (np.take_along_axis(x, keep, 1) for x in (cost, node, tree))
        return cost, tree, node


def fitted(classes: DataFrame, count: int, trees: int, leaf_rows: int, seed: int) -> Forest:
    """Trees of leaves of about `leaf_rows` of the `count` vectors, fitted on at most SAMPLE_BYTES of them, drawn by a hash."""
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / F.lit(unit)) * (x / F.lit(unit)))
    dims, unit = classes.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    norm = float(np.sqrt(classes.agg(F.max(size(F.col("v")))).first()[0]))
    rows = max(1024, SAMPLE_BYTES // (8 * dims))
    every = -(-count // rows)
    drawn = classes.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(every)) == 0).select("v").limit(2 * rows)
    sample = matrix(drawn.toArrow().column("v"), dims)
    depth = 0 if count <= 4 * leaf_rows else int(np.log2(count / leaf_rows))
    depth = max(0, min(depth, int(np.log2(max(1, len(sample)) / 8)) if len(sample) >= 8 else 0, dims + 1))
    r, trees = np.random.default_rng(seed), trees if depth else 1
    turns = np.stack([np.linalg.qr(r.standard_normal((dims + 1, dims + 1)))[0][:, :depth] for _ in range(trees)])
    return Forest(dims, float(unit), norm, depth, turns).fit(sample)


def _indexed(forest) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for b in batches:
            ids, leaves = b.column("id").to_numpy(), f.leaves(matrix(b.column("v"), f.dims))
            n, trees = leaves.shape
            yield pa.record_batch([pa.array(np.repeat(ids, trees)), pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(leaves.ravel().astype(np.int32))], schema=_ROW)

    return run


def _visits(forest, wanted: int, shift: int):
    schema = pa.schema([("id", pa.int64()), ("tree", pa.int32()), ("cell", pa.int32()), ("leaves", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = part.column("id").to_numpy()
                _, tree, leaf = f.queue(matrix(part.column("v"), f.dims), wanted)
                row = np.repeat(np.arange(len(ids)), tree.shape[1])
                tree, leaf = tree.ravel(), leaf.ravel()
                order = np.lexsort((leaf, tree, row))
                row, tree, leaf = row[order], tree[order], leaf[order]
                cell = leaf >> shift
                first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(tree) != 0) | (np.diff(cell) != 0)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(leaf)].astype(np.int32)), pa.array(leaf.astype(np.int32)))
                yield pa.record_batch([pa.array(ids[row[first]]), pa.array(tree[first].astype(np.int32)), pa.array(cell[first].astype(np.int32)), lists], schema=schema)

    return run


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, components added from the first to the last, so that they do not depend on blocks."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * v[:, d]
    return total


_FOUND = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
_FOUND_SQL = "query long, id long, score double"


def _best(q: np.ndarray, v: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and exact score of the `keep` largest scores of each row that are not -inf."""
    keep = min(keep, scores.shape[1])
    at = np.argpartition(-scores, keep - 1, axis=1)[:, :keep] if keep < scores.shape[1] else np.tile(np.arange(scores.shape[1]), (len(q), 1))
    row, col = np.repeat(np.arange(len(q)), keep), at.ravel()
    ok = scores[row, col] > -np.inf
    row, col = row[ok], col[ok]
    return row, col, products(q[row], v[col])


def _scored(dims: int, keep: int, bounded: bool = False):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        left = left.sort_by("leaf")
        ids, v, leaf = left.column("id").to_numpy(), matrix(left.column("v"), dims), left.column("leaf").to_numpy()
        starts = np.flatnonzero(np.r_[True, np.diff(leaf) != 0])
        out = []
        for at in range(0, right.num_rows, 512):
            part = right.slice(at, 512)
            q = matrix(part.column("v"), dims)
            lists = pa.concat_arrays(part.column("leaves").chunks)
            ends = lists.offsets.to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(ends))
            visited = np.zeros((len(lists), len(starts)), bool)
            wanted = lists.values.to_numpy()[ends[0] : ends[-1]]
            place = np.minimum(np.searchsorted(leaf[starts], wanted), len(starts) - 1)
            there = leaf[starts][place] == wanted
            visited[row[there], place[there]] = True
            scores = np.full((len(q), len(v)), -np.inf)
            for n, start in enumerate(starts):
                who, end = np.flatnonzero(visited[:, n]), starts[n + 1] if n + 1 < len(starts) else len(v)
                if len(who):
                    scores[who, start:end] = q[who] @ v[start:end].T
            if bounded:  # what falls short of as many as are wanted, by more than rounding
                bound = part.column("bound").to_numpy()[:, None]
                scores[scores < bound - 1e-9 * np.abs(bound)] = -np.inf
            row, col, score = _best(q, v, scores, keep)
            out.append(pa.table([part.column("id").to_numpy()[row], ids[col], score], schema=_FOUND))
        return pa.concat_tables(out)

    return run


def _exhaustive(trials, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = trials.value
        schema = pa.schema([*_FOUND, ("v", pa.list_(pa.float64()))])
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                v = matrix(part.column("v"), q.shape[1])
                row, col, score = _best(q, v, q @ v.T, keep)
                yield pa.record_batch([pa.array(names[row]), part.column("id").take(pa.array(col)), pa.array(score), part.column("v").take(pa.array(col)).cast(schema.field("v").type)], schema=schema)

    return run


def wanted_leaves(forest: Forest, classes: DataFrame, asked: DataFrame, k: int, recall: float) -> int:
    """How many leaves the queue has to give so that `recall` of the k nearest classes of some queries, which are found among
    all vectors, lie in them."""
    most = len(forest.turns) << forest.depth
    trials = asked.orderBy(F.xxhash64("id"), "id").limit(min(TRIALS, max(1, SAMPLE_BYTES // (8 * forest.dims)))).toArrow()
    names, q = trials.column("id").to_numpy(), matrix(trials.column("v"), forest.dims)
    if not len(names) or not forest.depth:
        return most
    found = classes.mapInArrow(_exhaustive(classes.sparkSession.sparkContext.broadcast((names, q)), k + 1), f"{_FOUND_SQL}, v array<double>")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)
    near = best.toArrow()
    row = {int(x): n for n, x in enumerate(names)}
    rows = np.array([row[x] for x in near.column("query").to_pylist()], np.int64)
    v = matrix(near.column("v"), forest.dims)
    other = ~(v == q[rows]).all(1)
    rows, leaves = rows[other], forest.leaves(v[other])
    cost, tree, leaf = forest.queue(q, most)
    order = np.argsort(cost, axis=1, kind="stable")
    place = np.empty((len(q), len(forest.turns), 1 << forest.depth), np.int64)
    place[np.arange(len(q))[:, None], np.take_along_axis(tree, order, 1), np.take_along_axis(leaf, order, 1)] = np.arange(most)
    if not len(rows):
        return min(most, 4)
    first = np.sort(place[rows[:, None], np.arange(len(forest.turns))[None, :], leaves].min(1))
    return int(min(most, max(4, first[min(len(first) - 1, int(np.ceil(recall * len(first))))] + 1)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 4, leaf_rows: int = 48, recall: float = 0.95, seed: int = 12) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k largest inner products found over all vectors but those of its
    own id.

    vectors and queries: (vec_id, v) as usable() makes them. Ties go to the smaller vec_id; with fewer than k candidates in
    the table all are given, whatever the trees say: queries that got too few are compared with all vectors. No query or no
    vector gives no row. An id counts once, of several vectors with the least. Vectors of unequal lengths meet in their
    common components. Scores are sums in order of the components, in double precision.
    """
    spark = vectors.sparkSession
    stage = Stages(spark, "forest")
    order = Window.partitionBy("v").orderBy("vec_id")
    ids = vectors.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    # of equal vectors the k + 1 least ids can be among k results; the numbers of classes are fixed by being written
    classes = stage(ids.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("id", F.monotonically_increasing_id()), "classes")
    asking = stage(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "asking")
    asked = stage(asking.select("v").distinct().withColumn("id", F.monotonically_increasing_id()), "asked")
    count = classes.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not count or not asked.head(1):
        return empty
    forest = fitted(classes, count, trees, leaf_rows, seed)
    shared = spark.sparkContext.broadcast(forest)
    wanted = wanted_leaves(forest, classes, asked, k, recall)
    shift = max(0, forest.depth - max(0, int(np.ceil(np.log2(count / CELL)))))

    placed = stage(classes.select("id", "v").mapInArrow(_indexed(shared), "id long, tree int, leaf int").withColumn("cell", F.shiftright("leaf", shift)), "placed")
    visits = stage(asked.mapInArrow(_visits(shared, wanted, shift), "id long, tree int, cell int, leaves array<int>"), "visits")
    cells = placed.groupBy("tree", "cell").agg(F.ceil(F.count("*") / (1.25 * CELL)).cast("int").alias("parts"))
    cells = cells.join(visits.groupBy("tree", "cell").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("lots")), ["tree", "cell"])
    cells = stage(cells, "cells")
    # a vector goes to one part of its cell and meets every lot of queries there, a query goes to one lot and meets every part
    one = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(cells, ["tree", "cell"]).select("id", "tree", "cell", "leaf", one("parts").alias("part"), every("lots").alias("lot")).join(classes.select("id", "v"), "id")
    right = visits.join(cells, ["tree", "cell"]).select("id", "tree", "cell", "leaves", one("lots").alias("lot"), every("parts").alias("part")).join(asked, "id")
    group = ["tree", "cell", "part", "lot"]
    meet = lambda l, r, **how: l.groupBy(group).cogroup(r.groupBy(group)).applyInArrow(_scored(forest.dims, k + 1, **how), _FOUND_SQL)
    found = stage(_merged(meet(left.where("tree = 0"), right.where("tree = 0")), k), "first")
    if len(forest.turns) > 1:  # the other trees' cells give what is no worse than what the first tree has given already
        bounds = found.groupBy(F.col("query").alias("id")).agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("bound"))
        rest = right.where("tree > 0").join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
        found = stage(_merged(found.unionByName(meet(left.where("tree > 0"), rest, bounded=True)), k), "found")

    least = min(k + 1, count)
    short = asked.join(found.groupBy(F.col("query").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= least), "id", "left_anti")
    short = stage(short, "short")
    if short.head(1):
        found = found.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(_merged(_all_scores(classes, short, k, forest.dims), k))
    return _ranked(found, classes, asking, asked, k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 best classes of each query, each once."""
    found = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    return found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1).drop("n")


def _all_scores(classes: DataFrame, asked: DataFrame, k: int, dims: int) -> DataFrame:
    """Queries against every class, in blocks of both: for those that the leaves gave too few candidates."""
    lots = max(1, -(-asked.count() // PART_QUERIES))
    parts = max(1, -(-classes.count() // CELL))
    one = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = classes.select("id", "v", F.lit(0).alias("leaf"), one(parts).alias("part"), every(lots).alias("lot"))
    right = asked.select("id", "v", F.array(F.lit(0)).alias("leaves"), one(lots).alias("lot"), every(parts).alias("part"))
    return left.groupBy("part", "lot").cogroup(right.groupBy("part", "lot")).applyInArrow(_scored(dims, k + 1), _FOUND_SQL)


def _ranked(found: DataFrame, classes: DataFrame, asking: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Classes back to rows: the k + 1 best ids of each different query, then each query's k without its own."""
    ids = found.join(classes.select("id", F.explode("ids").alias("vec_id")), "id").select("query", "vec_id", "score")
    first = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    best = ids.withColumn("n", F.row_number().over(first("query"))).where(F.col("n") <= k + 1).drop("n")
    rows = asking.withColumnRenamed("vec_id", "query_id").join(asked.withColumnRenamed("id", "query"), "v").select("query_id", "query").join(best, "query").where("vec_id <> query_id")
    rows = rows.withColumn("rank", F.row_number().over(first("query_id"))).where(F.col("rank") <= k)
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_forest(spark, sf_dir: str) -> DataFrame:
    """Every twentieth vector's neighbours among all; nulls and odd cases as in usable() and nearest()."""
    v = usable(table(spark, sf_dir, "embeddings"))
    return nearest(v, v.where("vec_id % 20 = 0"))
