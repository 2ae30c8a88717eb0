"""Fill-in-middle transformation over a piece table.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: the text and the
sentinels. Cutting splits a descriptor, an arrangement permutes descriptors, its inverse permutation restores the order,
and digests stream the descriptors without building the document. Bytes are joined once, when the output is written.

Work is one pass over the documents, a batch of rows at a time; rows never meet, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.llm.shared import table, text_of

TEXT, SENTINELS = 0, 1  # buffers
Piece = tuple[int, int, int]  # buffer, start, length

#: The order of the six pieces of an output.
ORDERS = {"psm": ("P", "prefix", "S", "suffix", "M", "middle"), "spm": ("S", "suffix", "P", "prefix", "M", "middle")}
PARTS = ("prefix", "middle", "suffix")


@dataclass(frozen=True)
class Rule:
    """How documents are cut and arranged. unit: "line" or "char"; rate: of 100 documents so many are transformed; spm: of
    100 transformed ones so many have the suffix first; seed: goes into the digest that draws; sentinels: for prefix,
    suffix and middle."""

    unit: str = "line"
    rate: int = 100
    spm: int = 50
    seed: int = 7
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def marks(self) -> dict[str, bytes]:
        p, s, m = (x.encode() for x in self.sentinels)
        if self.unit not in ("line", "char") or not p or not s or not m or any(a in b for a in (p, s, m) for b in (p, s, m) if a is not b):
            raise ValueError("unit is line or char; sentinels are three different strings, none within another")
        return {"P": p, "S": s, "M": m}


def bounds(data: np.ndarray, unit: str) -> np.ndarray:
    """The n + 1 byte offsets at which the n units of a UTF-8 text begin and the last one ends."""
    if unit == "char":
        at = np.flatnonzero((data & 0xC0) != 0x80)
    else:
        at = np.concatenate([[0], np.flatnonzero(data == 10) + 1]) if len(data) else np.zeros(0, np.int64)
        at = at[at < len(data)]
    return np.append(at, len(data))


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The same document with a border `at` bytes from its start; the descriptor that covers it is split, an empty one may result."""
    out, before = [], 0
    for n, (buffer, start, length) in enumerate(pieces):
        if at <= before + length:
            return [*out, (buffer, start, at - before), (buffer, start + at - before, before + length - at), *pieces[n + 1 :]]
        out.append((buffer, start, length))
        before += length
    raise IndexError(at)


def arranged(parts: dict[str, Piece], order: tuple[str, ...]) -> list[Piece]:
    return [parts[name] for name in order]


def restored(pieces: list[Piece], order: tuple[str, ...]) -> list[Piece]:
    """The inverse permutation: the text's own parts in the text's order."""
    place = {name: n for n, name in enumerate(order)}
    return [pieces[place[name]] for name in PARTS]


def digest(pieces: list[Piece], buffers: tuple[memoryview, memoryview]) -> str:
    h = hashlib.sha256()
    for buffer, start, length in pieces:
        h.update(buffers[buffer][start : start + length])
    return h.hexdigest()


def joined(pieces: list[Piece], buffers: tuple[memoryview, memoryview]) -> bytes:
    return b"".join(buffers[buffer][start : start + length] for buffer, start, length in pieces)


def sentinel_pieces(marks: dict[str, bytes]) -> tuple[memoryview, dict[str, Piece]]:
    """The sentinels' buffer and a descriptor of each."""
    at, out = 0, {}
    for name, mark in marks.items():
        out[name] = (SENTINELS, at, len(mark))
        at += len(mark)
    return memoryview(b"".join(marks.values())), out


def _column(b: pa.RecordBatch, name: str) -> tuple[bytes, np.ndarray]:
    """A text column's bytes and the offsets of its rows."""
    a = b.column(name)
    _, ends, data = a.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(a.type) else np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
    return data.to_pybytes() if data is not None else b"", ends


def _texts(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _transform(rule: Rule, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = rule.marks()
        own, sentinels = sentinel_pieces(marks)
        for b in batches:
            data, ends = _column(b, "text")
            units, buffers = np.frombuffer(data, np.uint8), (memoryview(data), own)
            rows: dict[str, list] = {k: [] for k in schema.names[1:]}
            for n, key in enumerate(b.column("key").to_pylist()):
                lo, hi = int(ends[n]), int(ends[n + 1])
                at = bounds(units[lo:hi], rule.unit)
                h = hashlib.sha256(f"{rule.seed}:{key}".encode()).hexdigest()
                h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
                whole, count = [(TEXT, lo, hi - lo)], len(at) - 1
                chars: tuple[int | None, int | None] = (None, None)
                if lo == hi or any(data.find(m, lo, hi) >= 0 for m in marks.values()) or h3 % 100 >= rule.rate:
                    form, pieces = "plain", whole
                else:
                    form = "spm" if h4 % 100 < rule.spm else "psm"
                    a, z = sorted((h1 % (count + 1), h2 % (count + 1)))
                    parts = dict(zip(PARTS, cut(cut(whole, int(at[z])), int(at[a])), strict=True))
                    pieces = arranged(sentinels | parts, ORDERS[form])
                    chars = tuple(int(np.count_nonzero((units[s : s + size] & 0xC0) != 0x80)) for _, s, size in (parts["prefix"], parts["middle"]))
                relative = [{"buffer": x, "start": s - lo if x == TEXT else s, "length": size} for x, s, size in pieces]
                for k, v in zip(rows, (count, form, *chars, relative, joined(pieces, buffers), digest(pieces, buffers)), strict=True):
                    rows[k].append(v)
            made = [_texts(v) if k == "output" else pa.array(v, schema.field(k).type) for k, v in rows.items()]
            yield pa.record_batch([b.column("doc_id").cast(schema.field("doc_id").type), *made], schema=schema)

    return run


_PIECE = pa.struct([("buffer", pa.int8()), ("start", pa.int64()), ("length", pa.int64())])
_OUT = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("pieces", pa.list_(_PIECE)), ("output", pa.string()), ("output_sha256", pa.string())]
_OUT_SQL = "n long, form string, prefix_chars long, middle_chars long, pieces array<struct<buffer:tinyint,start:bigint,length:bigint>>, output string, output_sha256 string"


def _id_type(docs: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def fill_in_middle(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, pieces, output, output_sha256) of every whole text of docs (doc_id, text).

    n counts the units, form is plain, psm or spm, output is the transformed text, pieces its descriptors: buffer 0 is the
    text, 1 the sentinels, start and length in bytes. A null text is the empty text and stays plain, as does a text that
    holds a sentinel: its output is the text itself, prefix_chars and middle_chars are null. A null doc_id draws by the
    seed alone. Repeated rows are transformed each by itself, equal ones alike; an empty table gives no row; other columns
    are not read. Very long texts take their own length and that of the output.
    """
    rule = rule or Rule()
    rule.marks()
    kind, arrow = _id_type(docs)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), text_of().alias("text"))
    return rows.mapInArrow(_transform(rule, pa.schema([("doc_id", arrow), *_OUT])), f"doc_id {kind}, {_OUT_SQL}")


def _restore(rule: Rule, passed: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = rule.marks()
        for b in batches:
            data, ends = _column(b, "output")
            buffers, texts, digests = (memoryview(data), memoryview(b"")), [], []
            for n, form in enumerate(b.column("form").to_pylist()):
                lo, hi = int(ends[n]), int(ends[n + 1])
                pieces = [(TEXT, lo, hi - lo)]
                if form in ORDERS:
                    order, at, borders = ORDERS[form], lo, []
                    for name in order[::2]:
                        at = data.index(marks[name], at, hi)
                        borders += [at, at + len(marks[name])]
                        at = borders[-1]
                    for border in borders[:0:-1]:  # from the last, so that the document's start stays the first descriptor's
                        pieces = cut(pieces[:1], border - lo) + pieces[1:]
                    pieces = restored(pieces, order)
                texts.append(joined(pieces, buffers))
                digests.append(digest(pieces, buffers))
            yield pa.record_batch([*(b.column(c).cast(schema.field(c).type) for c in passed), _texts(texts), pa.array(digests, pa.string())], schema=schema)

    return run


def restore(rows: DataFrame, rule: Rule | None = None) -> DataFrame:
    """rows with `text`, rebuilt from the columns `output` and `form` alone, and `restored_sha256`; other columns stay. A null
    output is the empty text; a form other than psm and spm says that the output is the text. An output that lacks a
    sentinel of its form is an error. Repeated rows are rows; an empty table gives none."""
    from pyspark.sql.pandas.types import to_arrow_type

    rule = rule or Rule()
    passed = [c for c in rows.columns if c not in ("text", "restored_sha256")]
    kinds = [rows.schema[c].dataType for c in passed]
    schema = pa.schema([*((c, to_arrow_type(k)) for c, k in zip(passed, kinds, strict=True)), ("text", pa.string()), ("restored_sha256", pa.string())])
    sql = ", ".join(f"`{c}` {k.simpleString()}" for c, k in zip(passed, kinds, strict=True))
    return rows.select(*passed).withColumn("output", text_of("output")).mapInArrow(_restore(rule, passed, schema), f"{sql}, text string, restored_sha256 string")


def op13_infill(spark, sf_dir: str) -> DataFrame:
    """Every document's form and digests; nulls and odd cases as in fill_in_middle()."""
    made = fill_in_middle(table(spark, sf_dir, "documents")).drop("pieces")
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id) as h from documents),
u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as l from d),
k as (select *, len(l) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[25:32] as bigint) as h4 from u),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as z,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from k),
p as (select *, coalesce(array_to_string(l[1:a], ''), '') as p, coalesce(array_to_string(l[a + 1:z], ''), '') as m, coalesce(array_to_string(l[z + 1:n], ''), '') as s from c)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then length(p) end as bigint) as prefix_chars, cast(case when form <> 'plain' then length(m) end as bigint) as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from p"""
