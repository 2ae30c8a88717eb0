"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Candidates are packed into blocks of rows, queries into blocks by a hash of their id. Each candidate block meets each
query block once, by a join on the query block's number; there, every dimension (term) with a weight in a query scatters
its postings, weighted, into dense score arrays. The k best of a block are selected by partition, and a window merges
the blocks' selections. Work grows with queries x rows, which an exhaustive search means; memory is bounded by the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUERIES = 4096, 256  # of a block of candidates and of one score array


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component. Vectors that are null or hold a null, NaN or infinite component
    take no part, nor do rows without an id."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("v"))


def _dense(ids: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of id as one integer matrix; missing components are 0."""
    ends = lists.offsets.to_numpy()
    sizes, flat = np.diff(ends), lists.values.to_numpy(zero_copy_only=False)
    m = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
    at = np.repeat(np.arange(len(ids)), sizes)
    m[at, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], sizes)] = flat[ends[0] : ends[-1]]
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def _packed(name: str):
    schema = pa.schema([("rows", pa.int32()), (f"{name}_ids", pa.binary()), (f"{name}_dims", pa.int32()), (f"{name}_matrix", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids, m = _dense(part.column("vec_id").to_numpy(), pa.concat_arrays([part.column("v")]))
                yield pa.record_batch([pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()]), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()])], schema=schema)

    return pack, f"rows int, {name}_ids binary, {name}_dims int, {name}_matrix binary"


def accumulate(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of the query rows q against the candidates c, one term after another: the postings of a term (candidate,
    weight) are scattered into the score arrays of the queries that have it."""
    scores = np.zeros((len(q), len(c)), np.int64)
    for term in range(min(q.shape[1], c.shape[1])):
        who, postings = np.flatnonzero(q[:, term]), np.flatnonzero(c[:, term])
        if not len(who) or not len(postings):
            continue
        if 2 * len(postings) > len(c):  # nearly every row has the term: adding zeros is cheaper than indexing
            part = np.multiply.outer(q[who, term], c[:, term])
            if len(who) == len(q):
                scores += part
            else:
                scores[who] += part
        else:
            scores[np.ix_(who, postings)] += np.multiply.outer(q[who, term], c[postings, term])
    return scores


def best_of(scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the `keep` highest scores of each row; equal scores at the end of them in order of the columns. The
    selection gives the score that is kept last; what is above it is taken, and of its equals the first ones."""
    if keep >= scores.shape[1]:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    last = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep, None]
    above, equal = scores > last, scores == last
    room = keep - above.sum(1, keepdims=True)
    many = np.flatnonzero(equal.sum(1) > room[:, 0])  # few rows have ties to settle
    equal[many] &= np.cumsum(equal[many], axis=1) <= room[many]
    return np.nonzero(above | equal)


def _score(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c_ids = np.frombuffer(r["c_ids"], np.int64)
                c = np.frombuffer(r["c_matrix"], np.int64).reshape(len(c_ids), r["c_dims"])
                all_ids = np.frombuffer(r["q_ids"], np.int64)
                all_q = np.frombuffer(r["q_matrix"], np.int64).reshape(len(all_ids), r["q_dims"])
                for at in range(0, len(all_ids), QUERIES):
                    q_ids, n = all_ids[at : at + QUERIES], len(c_ids)
                    scores = accumulate(all_q[at : at + QUERIES], c)
                    own = q_ids[:, None] == c_ids[None, :]
                    keep = min(n, k + int(own.sum(1).max(initial=0)))
                    rows, cols = best_of(scores, keep)
                    ok = ~own[rows, cols]
                    rows, cols = rows[ok], cols[ok]
                    yield pa.record_batch([pa.array(q_ids[rows]), pa.array(c_ids[cols]), pa.array(scores[rows, cols])], schema=schema)

    return score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, queries_a_block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k highest scores over all vectors but those with its own id.

    vectors and queries: (vec_id, v) of integers, as quantised() makes them. Ties go to the smaller vec_id; fewer than k
    candidates give all of them; no query or no candidate gives no row. Repeated rows of an id are candidates each;
    of a query's repeated rows the least vector counts. Vectors of unequal lengths meet in their common components.
    """
    spark = vectors.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // queries_a_block))
    pack_q, schema_q = _packed("q")
    pack_c, schema_c = _packed("c")
    q = queries.repartition(blocks, F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).mapInArrow(pack_q, schema_q)
    # A query block's number is spread over the rows that one of its tasks packs, so that each meets all candidates
    q = q.withColumn("block", F.spark_partition_id() % blocks)
    c = vectors.mapInArrow(pack_c, schema_c).drop("rows").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = c.join(q.drop("rows"), "block").repartition(parts)
    found = pairs.mapInArrow(_score(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    """Every fiftieth vector's five highest scores among all; nulls, repeats, few and no rows as in quantised() and top_k(). A
    very long vector takes its length times a block's rows; sums beyond 64 bits are not foreseen."""
    from regionframe.llm.shared import table

    v = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.where("vec_id % 50 = 0"))


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda p: q.v[p] * c.v[p])) as bigint) as score
      from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""
