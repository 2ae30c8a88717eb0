"""Packing documents into windows by minimum bin slack.

A document's ids fill whole windows first; what remains of each is a length below the window. For each window the longest
remaining length is set, and a subset-sum dynamic program over the multiset of the other lengths, kept as one bitset,
finds the sum that comes closest to the capacity; its counts are traced back and taken as often as the multiset has them.
Where no sum is exact, one more remainder is cut to fill the gap. Each task packs its own rows, a block of bounded size
at a time, so nothing is shuffled; the last window of a block is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.llm.shared import table, text_of
from regionframe.llm.tokens import encoder, vocabulary

BLOCK = 4_000_000  # ids that a task packs at once
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def closest(lengths: list[int], counts: list[int], capacity: int) -> tuple[dict[int, int], int]:
    """Of a multiset (ascending lengths, how many of each at most) the counts whose sum comes closest below the capacity,
    and that sum. Bit b of `reach` says that b can be made; longest first, it stops where the capacity itself can be."""
    reach, every, steps = 1, (1 << (capacity + 1)) - 1, []
    for i in range(bisect_left(lengths, capacity + 1) - 1, -1, -1):
        length, n, part = lengths[i], min(counts[lengths[i]], capacity // lengths[i]), 1
        while n > 0:
            part = min(part, n)
            steps.append((length, part, reach))
            reach |= reach << part * length & every
            n, part = n - part, 2 * part
        if reach >> capacity & 1:
            break
    at = best = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, part, was in reversed(steps):
        if not was >> at & 1:
            taken[length] = taken.get(length, 0) + part
            at -= part * length
    return taken, best


def windows_of(sizes: list[int], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document's place, start, length), for documents of these many ids. Only the last windows are
    below the window's size, and those are powers of two."""
    pool: dict[int, list[tuple[int, int]]] = {}
    for d, n in enumerate(sizes):
        for start in range(0, n - window + 1, window):
            yield [(d, start, window)]
        if rest := n % window:
            pool.setdefault(rest, []).append((d, n - rest))
    lengths, counts = sorted(pool), [0] * (window + 1)
    for k, v in pool.items():
        counts[k] = len(v)

    def pop(length: int) -> tuple[int, int, int]:
        d, start = pool[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del lengths[bisect_left(lengths, length)]
        return d, start, length

    while lengths:
        longest = lengths[-1]
        counts[longest] -= 1
        taken, total = closest(lengths, counts, window - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        gap = window - longest - total
        for _ in range(min(counts[k] // n for k, n in taken.items()) if not gap else 1):
            out = [pop(k) for k, n in taken.items() for _ in range(n)]
            if gap and (at := bisect_left(lengths, gap + 1)) < len(lengths):
                d, start, length = pop(lengths[at])
                out.append((d, start, gap))
                pool.setdefault(length - gap, []).append((d, start + gap))
                counts[length - gap] += 1
                if counts[length - gap] == 1:
                    insort(lengths, length - gap)
            if sum(x[2] for x in out) == window:
                yield out
            else:
                yield from _powers(out)


def _powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces cut anew into windows of the powers of two that make up their sum."""
    pieces, left = pieces[::-1], sum(x[2] for x in pieces)
    while left:
        room, out = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            d, start, length = pieces.pop()
            if length > room:
                pieces.append((d, start + room, length - room))
            out.append((d, start, min(length, room)))
            room -= out[-1][2]
        yield out


def _packer(path: str, end_id: int, window: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])

    def block(docs: list, ids: list[bytes], part: int, first: int) -> Iterator[pa.RecordBatch]:
        rows, sequence = [], first
        sizes = [len(x) // 4 for x in ids]
        for w in windows_of(sizes, window):
            offset = 0
            for d, start, length in w:
                own = memoryview(ids[d])[4 * start : 4 * (start + length)]
                rows.append((docs[d], start, length, zlib.crc32(own), sizes[d], part << 36 | sequence, offset, bytes(own) if with_ids else None))
                offset += length
            sequence += 1
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at : at + 10_000], strict=True)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, docs, ids, held, blocks, part = encoder(path).encode, [], [], 0, 0, 0
        for b in batches:
            for doc, text, part in zip(b["doc_id"].to_pylist(), b["text"], b["part"].to_pylist(), strict=True):
                docs.append(doc)
                ids.append(encode(text.as_py()) + end)
                held += len(ids[-1]) // 4
                if held >= BLOCK:
                    yield from block(docs, ids, part, blocks << 24)
                    docs, ids, held, blocks = [], [], 0, blocks + 1
        if docs:
            yield from block(docs, ids, part, blocks << 24)

    return pack


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, window: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents' ids in windows of at most `window` ids; each id lies in one piece.

    Needs doc_id and text; a null text is empty and so has its end id alone; other columns are left out. A piece has
    doc_id, start (of its document's ids), length, ids_crc32, doc_tokens, sequence_id, offset and, with_ids, its ids.
    Every sequence has `window` ids or a power of two. Repeated rows are packed each; an empty table gives no row. Which
    documents share a window depends on how the rows lie in partitions; sequence_id is unique, not gapless.
    """
    d = docs.select("doc_id", text_of().alias("text")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().cast("long").alias("part"))
    out = d.mapInArrow(_packer(path or vocabulary("word_bpe_49k.json"), end_id, window, with_ids), PIECE)
    return out if with_ids else out.drop("ids")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document, a row each; a null text is its end id alone, repeated rows are packed each, an empty table
    gives no piece, a very long text fills as many sequences as it needs."""
    return pack(table(spark, sf_dir, "documents"))
