"""Repeated passages by a depth-limited radix sort of suffixes.

Every place where `window` units (bytes, or words) fit begins a suffix. Suffixes are ordered only through their first
`window` units, most significant digit first: a pass numbers the groups of equal digits in their order, groups of one
suffix are dropped, and the next digit splits the groups that are left. A digit is the number that an earlier pass gave to
the units at its place, so digits double in length, and a few passes reach the window. Equal groups that are left then
are exactly the repeated windows. The sort runs in tasks, over groups that hold all suffixes that can be equal:

1. A window's least gram is its bucket; equal windows have equal grams at equal places. Neighbouring windows share it, so
   one row stands for a run of them. Windows that equal those one period before them, as in ruled lines and constant
   stretches, repeat there and then and leave the earlier ones to stand for them.
2. Runs are counted by the digests of gram and run, 128 bits in all: copies of a run repeat wholly. Where a bucket holds
   another run and one without a copy, the units of one place of each are read.
3. A bucket of at most MEMBERS such runs is sorted in one task. A larger one is first split by Spark, in the same way, by
   digits that blocks of its windows share; a group that stays large through all of them is split by what is left of
   each window, and counted.

Runs, digits and windows are counted by partial sums before they are shuffled and joined back, so a passage that very many
documents share makes no large group anywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionframe.llm.shared import Stages, table, text_of

BLOCK, UNITS = 64, 4_000_000  # windows of a block; units that are worked on at once
MEMBERS = 256  # runs of a bucket, or blocks of a group, that one task sorts
END = 64  # units of the first digit that splits a large bucket, at either end of a block
WORD = re.compile(r"\S+")
KEY = ["doc_id", "version"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram, by doubling: two halves make a whole. One for each place where a gram fits."""
    h, size, out, done = _mix(units.astype(np.uint64) + np.uint64(1)), 1, None, 0
    while size <= gram:
        if gram & size:
            out, done = (h, size) if out is None else (_mix(out[: len(out) - size] * np.uint64(0xD6E8FEB86659FD93) + h[done:][: len(out) - size]), done + size)
        h, size = _mix(h[: len(h) - size] * np.uint64(0xD6E8FEB86659FD93) + h[size:]) if len(h) > size else h[:0], size * 2
    return out


def runs_of(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with the same least gram, as (document, first, last, gram's place); a window lies
    within one document's [start, end)."""
    none = (np.empty(0, np.int64),) * 4
    if len(units) < window:
        return none
    v = _mix(gram_hashes(units, gram)) & np.uint64(0xFFFFFFFF00000000)
    v |= np.arange(len(v), dtype=np.uint64)
    width, size = window - gram + 1, 1
    least = v
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    n = np.maximum(0, ends - starts - window + 1)
    doc = np.repeat(np.arange(len(starts)), n)
    if not len(doc):
        return none
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], at[new], at[last], place[new]


def periodic(data: memoryview, size: int, starts: np.ndarray, runs: tuple[np.ndarray, ...], window: int, gram: int) -> np.ndarray:
    """Which runs have all their windows once more one period earlier in their document, in the run before."""
    doc, first, last, place = runs
    out, step = np.zeros(len(doc), bool), np.diff(place)
    likely = np.flatnonzero((doc[1:] == doc[:-1]) & (step > 0) & (step <= window) & (first[1:] - step >= starts[doc[1:]])) + 1
    grams = np.frombuffer(data, np.uint8 if size == 1 else np.uint64)
    likely = likely[grams[place[likely]] == grams[place[likely - 1]]]
    for i in likely.tolist():
        p, q, a, b = int(place[i]), int(step[i - 1]), int(first[i]), int(last[i]) + window
        if data[p * size : (p + gram) * size] == data[(p - q) * size : (p - q + gram) * size]:
            out[i] = data[a * size : b * size] == data[(a - q) * size : (b - q) * size]
    return out


def digests(parts: Iterator[bytes | memoryview]) -> np.ndarray:
    """64 bits of each, as a signed integer."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64).view(np.int64)


def units_of(text: str, unit: str) -> bytes:
    """A text's units, in one byte each or, for words (runs of non-space), a hash of eight."""
    return text.encode() if unit == "byte" else np.fromiter(map(xxhash.xxh3_64_intdigest, WORD.findall(text)), np.uint64).tobytes()


def _pieces(batch: pa.RecordBatch, unit: str, window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, first unit, units), each of about UNITS units at most; a longer text comes in pieces that overlap,
    so that each of its windows lies in one."""
    size, got, held = 1 if unit == "byte" else 8, [], 0
    for row, text in enumerate(batch["text"]):
        data = units_of(text.as_py(), unit)
        for at in range(0, max(1, len(data) // size - window + 1), UNITS):
            got.append((row, at, data[at * size : (at + UNITS + window - 1) * size] if len(data) > UNITS * size else data))
            held += len(got[-1][2])
            if held >= UNITS * size:
                yield got
                got, held = [], 0
    if got:
        yield got


RUN = "doc_id long, version long, first int, windows int, place int, gram long, run long"


def _runs(window: int, gram: int, unit: str):
    """Rows of runs; those that are periodic have no gram and cover, all in a row as one, [first, first + windows)."""
    size = 1 if unit == "byte" else 8

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for got in _pieces(b, unit, window):
                data = memoryview(b"".join(x for *_, x in got))
                ends = np.cumsum([len(x) // size for *_, x in got])
                starts, base = np.concatenate([[0], ends[:-1]]), np.array([at for _, at, _ in got])
                rows = np.array([row for row, *_ in got])
                doc, first, last, place = found = runs_of(np.frombuffer(data, np.uint8 if size == 1 else np.uint64), starts, ends, window, gram)
                if not len(doc):
                    continue
                again = periodic(data, size, starts, found, window, gram)
                if again.any():
                    # neighbouring ones are one row: [first less a period, last + window)
                    new = np.flatnonzero(again & ~np.concatenate([[False], again[:-1] & (doc[1:] == doc[:-1])]))
                    stop = np.flatnonzero(again & ~np.concatenate([again[1:] & (doc[1:] == doc[:-1]), [False]]))
                    back = first[new] - (place[new] - place[new - 1])
                    shift = base[doc[new]] - starts[doc[new]]
                    own, none = pa.array(rows[doc[new]]), pa.nulls(len(new), pa.int64())
                    yield pa.RecordBatch.from_arrays([b["doc_id"].take(own), b["version"].take(own), pa.array((back + shift).astype(np.int32)), pa.array((last[stop] + window - back).astype(np.int32)), pa.array(np.zeros(len(new), np.int32)), none, none], names=["doc_id", "version", "first", "windows", "place", "gram", "run"])
                    doc, first, last, place = (x[~again] for x in found)
                whole = digests(data[i * size : (j + window) * size] for i, j in zip(first.tolist(), last.tolist(), strict=True))
                grams = digests(data[p * size : (p + gram) * size] for p in place.tolist())
                own = pa.array(rows[doc])
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(own), b["version"].take(own), pa.array((first - starts[doc] + base[doc]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array((place - first).astype(np.int32)), pa.array(grams), pa.array(whole)],
                    names=["doc_id", "version", "first", "windows", "place", "gram", "run"],
                )

    return runs


CONTENT = "gram long, members long, n long, doc_id long, version long, first int, windows int, place int, content binary"
BLOCKS = "gram long, block int, n long, doc_id long, version long, first int, windows int, place int, at int, content binary"
SINGLES = "group long, block int, place int, n long, doc_id long, version long, first int, sides binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _batches(rows: Iterator[tuple], ddl: str, most: int = 4000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    schema, held = _schema(ddl), []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _contents(window: int, unit: str):
    """The units of the asked runs of each text."""
    size = 1 if unit == "byte" else 8

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for doc, version, text, asked in zip(b["doc_id"].to_pylist(), b["version"].to_pylist(), b["text"], b["asked"], strict=True):
                data = units_of(text.as_py(), unit)
                for r in asked.as_py():
                    yield r["gram"], r["members"], r["n"], doc, version, r["first"], r["windows"], r["place"], data[r["first"] * size : (r["first"] + r["windows"] - 1 + window) * size]

    return lambda batches: _batches(rows(batches), CONTENT)


def _blocks(window: int, unit: str):
    """Blocks of the windows of a run, by their distance to the gram. `at` is where, in the units of the block's windows,
    those begin that all windows of a whole block have: window - width + 1 units."""
    size, width = 1 if unit == "byte" else 8, max(1, min(BLOCK, window // 3))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for r in b.to_pylist():
                n, place = r["windows"], r["place"]
                for block in range((place - n + 1) // width, place // width + 1):
                    lo, hi = max(0, place - (block + 1) * width + 1), min(n - 1, place - block * width)
                    yield r["gram"], block, r["n"], r["doc_id"], r["version"], r["first"] + lo, hi - lo + 1, place - lo, place - block * width - lo, r["content"][lo * size : (hi + window) * size]

    return lambda batches: _batches(rows(batches), BLOCKS)


def _singles(window: int, unit: str):
    """Each window of the blocks, with the units that its block does not have in common."""
    size, width = 1 if unit == "byte" else 8, max(1, min(BLOCK, window // 3))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for r in b.to_pylist():
                a, data = r["at"], r["content"]
                for lo in range(r["windows"]):
                    sides = data[lo * size : a * size] + data[(a + window - width + 1) * size : (lo + window) * size]
                    yield r["group"], r["block"], r["place"] - lo, r["n"], r["doc_id"], r["version"], r["first"] + lo, sides

    return lambda batches: _batches(rows(batches), SINGLES)


def numbered(high: np.ndarray, low: np.ndarray | None, most: int) -> np.ndarray:
    """One pass: the places in order of (high, low), groups of equal ones numbered in that order, -1 for groups of one."""
    key = high if low is None else high * np.int64(most) + low
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    alone = new & np.append(new[1:], True)
    number = np.cumsum(new & ~alone) - 1
    out = np.empty(len(key), np.int64)
    out[order] = np.where(alone, -1, number)
    return out


def equal_windows(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """For each place the number of its group of equal windows, -1 where its window equals no other or would leave its
    row [start, end). The depth-limited radix sort."""
    length, n = 1, len(units)
    digit, end = units, np.repeat(ends, ends - starts)
    if units.dtype == np.uint8:
        length = min(8, window)
        digit = np.zeros(n, np.uint64)
        for j in range(length):
            digit[: n - j] = digit[: n - j] << np.uint64(8) | units[j:]
            digit[n - j :] <<= np.uint64(8)
    group = np.full(n, -1, np.int64)
    at = np.flatnonzero(np.arange(n) + length <= end)
    if len(at):
        group[at] = numbered(digit[at], None, 0)
    while length < window:
        step = min(length, window - length)
        at = np.flatnonzero(group >= 0)
        at = at[at + step < end[at]]
        at = at[group[at + step] >= 0]
        high, low = group[at], group[at + step]
        group = np.full(n, -1, np.int64)
        if not len(at):
            break
        group[at] = numbered(high, low, int(low.max()) + 1)
        length += step
    return group


def _sorted(window: int, unit: str):
    """The repeated windows of runs without a copy, as spans. Rows come in order of their group, and a group has at most
    a bounded number of rows; several groups are sorted at once, as windows of different groups are never equal."""
    kind = np.uint8 if unit == "byte" else np.uint64
    size = np.dtype(kind).itemsize

    def spans(rows: list[tuple]) -> Iterator[tuple]:
        lengths = np.array([len(r[-1]) // size for r in rows])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        same = equal_windows(np.frombuffer(b"".join(r[-1] for r in rows), kind), starts, ends, window) >= 0
        for (n, doc, version, first, windows, _), a in zip(rows, starts.tolist(), strict=True):
            if n > 1:
                continue
            own = np.flatnonzero(same[a : a + windows])
            if not len(own):
                continue
            gaps = np.flatnonzero(np.diff(own) > window)
            for lo, hi in zip(own[np.append(0, gaps + 1)].tolist(), own[np.append(gaps, len(own) - 1)].tolist(), strict=True):
                yield doc, version, first + lo, first + hi + window

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, units, last = [], 0, None
        for b in batches:
            columns = [b[c].to_pylist() for c in ("group", "block", "n", "doc_id", "version", "first", "windows", "content")]
            for group, block, *row in zip(*columns, strict=True):
                if units >= UNITS // 2 and (group, block) != last:
                    yield from spans(held)
                    held, units = [], 0
                held.append(tuple(row))
                units += len(row[-1]) // size
                last = (group, block)
        if held:
            yield from spans(held)

    return lambda batches: _batches(found(batches), "doc_id long, version long, first int, end int", 20_000)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text): version tells apart rows that share a doc_id but not the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("version"), text_of().alias("text"))


def on_key(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.version") == F.col(f"{b}.version"))


def in_groups(items: DataFrame, window: int, unit: str) -> DataFrame:
    """Spans (doc_id, version, first, end) of the repeated windows of items' runs without a copy; a row of items is a run
    or block of windows, and (group, block) has MEMBERS rows at most."""
    items = items.select("group", "block", "n", "doc_id", "version", "first", "windows", "content")
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # sorting is work: small partitions stay apart
    return items.repartition(parts, "group", "block").sortWithinPartitions("group", "block").mapInArrow(_sorted(window, unit), "doc_id long, version long, first int, end int")


def split(stage: Stages, items: DataFrame, key: list[str], digit: Column) -> DataFrame:
    """One pass over all of a large bucket: items in groups of equal key and digit, numbered in their order as `group`,
    with the number of members; groups of one are dropped."""
    d = items.withColumn("digit", digit)
    groups = d.groupBy(*key, "digit").agg(F.count("*").alias("next_members")).where("next_members > 1")
    groups = stage(groups.orderBy(*key, "digit").withColumn("next", F.monotonically_increasing_id()), "digits")
    kept = d.join(groups, [*key, "digit"]).drop("digit", "members", *(["group"] if "group" in items.columns else []))
    return stage(kept.withColumnsRenamed({"next": "group", "next_members": "members"}), "items")


def in_large(stage: Stages, runs: DataFrame, window: int, unit: str) -> DataFrame:
    """As in_groups(), for the runs (CONTENT) of buckets of any size."""
    size, width = 1 if unit == "byte" else 8, max(1, min(BLOCK, window // 3))
    core, end = window - width + 1, min(END, (window - width + 1) // 2)
    blocks = stage(runs.mapInArrow(_blocks(window, unit), BLOCKS), "blocks")
    # Blocks of equal units repeat wholly, and one of them stands for all
    alike = ["gram", "block", "windows", "place", "at", "content"]
    row = F.first(F.struct(*KEY, "first")).alias("row")
    items = stage(blocks.groupBy(*alike).agg(F.count("*").alias("copies"), F.sum("n").alias("n"), row), "block-kinds")
    whole = blocks.where("n = 1").join(items.where("copies > 1").select(*alike), alike).select(*KEY, "first", (F.col("first") + F.col("windows") - 1 + window).alias("end"))
    items = items.select(*alike, "n", "row.*")
    part = lambda first, n: F.substring("content", (F.col("at") + first) * size + 1, F.lit(n * size))
    first = split(stage, items, ["gram", "block"], F.concat(part(0, end), part(core - end, end)))
    out = whole.union(in_groups(first.where(F.col("members") <= MEMBERS), window, unit))
    rest = split(stage, first.where(F.col("members") > MEMBERS), ["group", "block"], part(end, core - 2 * end))
    out = out.union(in_groups(rest.where(F.col("members") <= MEMBERS), window, unit))
    same_core = rest.where(F.col("members") > MEMBERS)  # equal through all that a block's windows have in common
    singles = stage(same_core.mapInArrow(_singles(window, unit), SINGLES), "singles")
    same = ["group", "block", "place", "sides"]
    equal = stage(singles.groupBy(*same).agg(F.count("*").alias("copies")).where("copies > 1").drop("copies"), "equal-singles")
    return out.union(singles.where("n = 1").join(equal, same).select(*KEY, "first", (F.col("first") + window).alias("end")))


def maximal(spans: DataFrame) -> DataFrame:
    """(doc_id, version, first, end): the maximal runs that spans cover. Windows are one document's, and each place comes
    once however often its row is repeated."""
    longest = spans.groupBy(*KEY, "first").agg(F.max("end").alias("end"))
    own = Window.partitionBy(*KEY).orderBy("first")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.coalesce((F.col("first") > F.col("before")).cast("int"), F.lit(1))).over(own)
    return longest.withColumn("before", before).withColumn("part", part).groupBy(*KEY, "part").agg(F.min("first").alias("first"), F.max("end").alias("end")).drop("part")


def repeated_spans(docs: DataFrame, window: int = 400, gram: int = 64, unit: str = "byte") -> DataFrame:
    """(doc_id, version, spans): for each row of keyed() with a repeated window the maximal runs (first, end) of units that
    its repeated windows cover. A window repeats if it starts at another place of any row, its own included; rows that
    repeat a document repeat its windows, a text of any length is looked at whole."""
    gram, stage = min(gram, window), Stages(docs.sparkSession, "repeats")
    seg, place = ["gram", "run"], ["doc_id", "version", "first", "windows", "place"]
    runs = stage(docs.mapInArrow(_runs(window, gram, unit), RUN), "runs")
    spans = runs.where("gram is null").select(*KEY, "first", (F.col("first") + F.col("windows")).alias("end"))
    # counts are staged before they are joined back, so that the join reads plain exchanges and can split a hot gram
    common = stage(runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1 and gram is not null").select("gram"), "common")
    live = stage(runs.join(common, "gram"), "live-runs")
    # first() of all columns is of one row: any place of a run will do
    kinds = stage(live.groupBy(*seg).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in place]), "run-kinds")
    whole = live.join(kinds.where("n > 1").select(*seg), seg).select(*KEY, "first", (F.col("first") + F.col("windows") - 1 + window).alias("end"))
    # Buckets with a run of its own and another one
    undecided = stage(kinds.groupBy("gram").agg(F.count("*").alias("members"), F.min("n").alias("least")).where("members > 1 and least = 1").select("gram", "members"), "undecided")
    asked = kinds.join(undecided, "gram").groupBy(*KEY).agg(F.collect_list(F.struct("gram", "members", "n", "first", "windows", "place")).alias("asked"))
    # a row that is repeated is read once: its copies are counted already
    content = docs.alias("d").join(asked.alias("l"), on_key("d", "l")).select("d.*", "l.asked").dropDuplicates(KEY) if _repeated(docs) else docs.alias("d").join(asked.alias("l"), on_key("d", "l")).select("d.*", "l.asked")
    content = stage(content.mapInArrow(_contents(window, unit), CONTENT), "run-contents")
    small = content.where(F.col("members") <= MEMBERS).withColumns({"group": F.col("gram"), "block": F.lit(0)})
    found = in_groups(small, window, unit)
    large = content.where(F.col("members") > MEMBERS)
    if large.head(1):
        found = found.union(in_large(stage, large, window, unit))
    out = stage(maximal(spans.union(whole).union(found)), "spans")
    stage.drop("runs", "common", "live-runs", "run-kinds", "undecided", "run-contents", "blocks", "block-kinds", "digits", "items", "singles", "equal-singles")
    return out.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))


def _repeated(docs: DataFrame) -> bool:
    """Whether any row comes more than once."""
    return bool(docs.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").head(1))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, removed, found, kept = [], [], [], []
        for text, spans in zip(b["text"], b["spans"].to_pylist(), strict=True):
            data, at, h = memoryview(text.as_buffer()) if text.as_buffer() else memoryview(b""), 0, hashlib.sha256()
            runs = [(s["first"], s["end"]) for s in spans or ()]
            for s, e in runs:
                h.update(data[at:s])
                at = e
            h.update(data[at:])
            sizes.append(len(data))
            removed.append(sum(e - s for s, e in runs))
            found.append(len(runs))
            kept.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(x, pa.int64()) for x in (sizes, removed, found)], pa.array(kept, pa.string()), b["n_repeated_words"]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words"])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    return docs.alias("d").join(spans.alias("s"), on_key("d", "s"), "left")


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    """Each document without the bytes that a 400-byte string with another start covers. A null text is empty; rows that
    repeat a document repeat its strings; a text of any length is looked at whole; an empty table gives no row.

    Passages of 50 words are often shorter than 400 bytes: n_repeated_words counts the words that a passage of 50 words or
    more with another start covers, as without_repeats() takes them out. No other column follows from it."""
    d = keyed(table(spark, sf_dir, "documents"))
    words = repeated_spans(d, 50, 8, "word").select(*KEY, F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.first).alias("n_repeated_words"))
    both = with_spans(d, repeated_spans(d)).select("d.*", "s.spans").alias("d").join(words.alias("w"), on_key("d", "w"), "left")
    both = both.select("d.doc_id", "d.text", "d.spans", F.coalesce("w.n_repeated_words", F.lit(0)).alias("n_repeated_words"))
    return both.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b["text"], b["spans"].to_pylist(), strict=True):
            if not spans:
                out.append(None)
                continue
            text = text.as_py()
            places, at, kept = [m.span() for m in WORD.finditer(text)], 0, []
            for s in spans:
                kept.append(text[at : places[s["first"]][0]])
                at = places[s["end"] - 1][1]
            out.append("".join([*kept, text[at:]]))
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(out, pa.string())], names=["row", "kept"])


def without_repeats(docs: DataFrame, words: int = 50, gram: int = 8) -> DataFrame:
    """The documents, with their columns, without the passages of `words` words or more that have another start anywhere;
    words are runs of non-space. Needs doc_id and text. A document that nothing is taken from stays as it is, a null text
    null; other columns, n_chars too, are not touched, whatever their names. Rows that repeat a document repeat its
    passages; a text of any length is looked at whole; an empty table gives no row."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("version"), text_of().alias("text"))
    joined = with_spans(d, repeated_spans(keyed(docs), words, gram, "word")).select("d.row", "d.text", "s.spans")
    kept = joined.mapInArrow(_without, f"row {joined.schema['row'].dataType.simpleString()}, kept string")
    return kept.select(*[F.coalesce("kept", "row.text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
