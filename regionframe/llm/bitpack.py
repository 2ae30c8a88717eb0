"""Token ids in files of fixed bit width: each id takes the least bits that the vocabulary needs.

A file holds whole documents: a header, the documents' ids and lengths, the byte offset of each block of BLOCK ids, and
the blocks. Thirty-two ids take `width` 32-bit words, so blocks are unpacked by shifts over whole columns, and the place
of any id follows from its number. Tasks write the files into the shared folder, each under a name of its attempt's own that
it gives up for the last name once the file is whole; a table of the files, written by Spark, names those that count, so that a
lost task's files do not. Readers open a file at its header and then at the blocks they want.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionframe.llm.shared import Stages, table, text_of
from regionframe.llm.tokens import encoder, vocabulary

MAGIC, HEAD, BLOCK, FILE_IDS = b"FWBP", struct.Struct("<4sIIQQ"), 4096, 2_000_000


def width_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


@functools.lru_cache(maxsize=4)
def vocabulary_size(path: str) -> int:
    """One more than the largest id that the tokenizer can give."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def packed(ids: np.ndarray, width: int) -> bytes:
    """ids in `width` bits each, lowest bit first; the last group of 32 is filled up with zeros. Raises on a larger id."""
    if len(ids) and int(np.max(ids)) >> width:
        raise ValueError(f"id {int(np.max(ids))} does not fit {width} bits")
    groups = -(-len(ids) // 32)
    full = np.zeros((groups, 32), np.uint64)
    full.ravel()[: len(ids)] = ids
    words = np.zeros((groups, width + 1), np.uint64)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        v = full[:, j] << np.uint64(shift)
        words[:, word] |= v & np.uint64(0xFFFFFFFF)
        words[:, word + 1] |= v >> np.uint64(32)
    return words[:, :width].astype("<u4").tobytes()


def unpacked(data: bytes | memoryview, width: int, n: int) -> np.ndarray:
    words = np.frombuffer(data, "<u4").reshape(-1, width)
    words = np.concatenate([words, np.zeros((len(words), 1), np.uint32)], axis=1).astype(np.uint64)
    out, mask = np.empty((len(words), 32), np.uint32), np.uint64((1 << width) - 1)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        out[:, j] = (words[:, word] | words[:, word + 1] << np.uint64(32)) >> np.uint64(shift) & mask
    return out.ravel()[:n]


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    """A whole file. A document without an id is marked in a byte a document."""
    data = packed(ids, width)  # a block is a whole number of groups, so all are packed at once
    offsets = np.append(np.arange(0, len(ids), BLOCK) // 32 * width * 4, len(data)).astype("<u8")
    known = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([x or 0 for x in doc_ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, width, BLOCK, len(doc_ids), len(ids)), known.tobytes(), names.tobytes(), np.array(lengths, "<u8").tobytes(), offsets.tobytes(), data])


class IdFile:
    """Reads a file: its documents, any block, or any range of ids. source: a file's bytes, or an open file that can seek."""

    def __init__(self, source) -> None:
        self.source = pa.BufferReader(source) if isinstance(source, (bytes, memoryview, pa.Buffer)) else source
        magic, self.width, self.block, docs, self.ids = HEAD.unpack(self._at(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        blocks = -(-self.ids // self.block) + 1
        head = self._at(HEAD.size, 17 * docs + 8 * blocks)
        self.known = np.frombuffer(head, np.uint8, docs).astype(bool)
        self.doc_ids = np.frombuffer(head, "<i8", docs, docs)
        self.lengths = np.frombuffer(head, "<u8", docs, 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(head, "<u8", blocks, 17 * docs).astype(np.int64)
        self.start = HEAD.size + len(head)

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def range(self, first: int, n: int) -> np.ndarray:
        """n ids from the place `first`: only the blocks that hold them are read and unpacked."""
        if n <= 0:
            return np.empty(0, np.uint32)
        a, b = first // self.block, (first + n - 1) // self.block
        data = self._at(int(self.start + self.offsets[a]), int(self.offsets[b + 1] - self.offsets[a]))
        return unpacked(data, self.width, min((b + 1) * self.block, self.ids) - a * self.block)[first - a * self.block :][:n]

    def crcs(self, at_once: int = 1 << 18) -> list[int]:
        """The crc32 of each document's ids, from a bounded number of ids at a time."""
        out, first, have, base = [], 0, np.empty(0, np.uint32), 0
        for n in self.lengths.tolist():
            crc, left = 0, n
            while left:
                if first >= base + len(have):
                    base, have = first, self.range(first, min(at_once, self.ids - first))
                part = have[first - base : first - base + left]
                crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                first, left = first + len(part), left - len(part)
            out.append(crc)
        return out


def opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store and the path of a folder, which may be a URI of any store that pyarrow knows."""
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)


def _write_file(folder: str, data: bytes) -> str:
    """Writes a file under a name of its own, then renames it: a name without .part is a whole file."""
    store, at = opened(folder)
    store.create_dir(at, recursive=True)
    name = f"{uuid.uuid4().hex}.ids"
    with store.open_output_stream(f"{at}/{name}.part") as out:
        out.write(data)
    store.move(f"{at}/{name}.part", f"{at}/{name}")
    return name


def _writer(path: str, end_id: int, width: int, folder: str):
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("name", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, docs, got, held, file, part = encoder(path).encode, [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(got), "<u4")
            name = _write_file(folder, file_bytes(docs, [len(x) // 4 for x in got], ids, width))
            return pa.record_batch([pa.array([x], f.type) for x, f in zip((part, file, len(docs), len(ids), name), schema, strict=True)], schema=schema)

        for b in batches:
            for doc, text, part in zip(b["doc_id"].to_pylist(), b["text"], b["part"].to_pylist(), strict=True):
                docs.append(doc)
                got.append(encode(text.as_py()) + end)
                held += len(got[-1]) // 4
                if held >= FILE_IDS:
                    yield flush()
                    docs, got, held, file = [], [], 0, file + 1
        if docs:
            yield flush()

    return write


def write_files(docs: DataFrame, path: str | None = None, end_id: int = 0, size: int | None = None) -> tuple[DataFrame, str]:
    """Writes all documents' ids in ascending doc_id order (null first; rows that repeat a doc_id by a digest of their texts)
    and returns the table of the files (part, file, docs, ids, name) and their folder, in the shared one.

    Needs doc_id and text; other columns are left out. A null text is empty and has its end id alone. Rows that repeat a
    document are written each; a text of any length is one document, within one file. `size` is the vocabulary's, as the
    tokenizer has it unless given; an id beyond it is an error. An empty table gives no file."""
    path = path or vocabulary("byte_bpe_50k.json")
    stage = Stages(docs.sparkSession, "id-files")
    folder, width = f"{stage.root}/files", width_for(size or vocabulary_size(path))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumns({"version": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    # equal rows may lie in several parts: in which order does not matter
    d = d.repartitionByRange("doc_id", "version", "row").sortWithinPartitions("doc_id", "version", "row").withColumn("part", F.spark_partition_id().cast("long"))
    return stage(d.select("doc_id", "text", "part").mapInArrow(_writer(path, end_id, width, folder), "part long, file long, docs long, ids long, name string"), "files"), folder


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = opened(folder)
        for b in batches:
            for part, file, name in zip(*[b[c].to_pylist() for c in ("part", "file", "name")], strict=True):
                with store.open_input_file(f"{at}/{name}") as source:
                    f = IdFile(source)
                    ends, crcs, n = np.cumsum(f.lengths), f.crcs(), len(f.lengths)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.full(n, file)), pa.array(f.doc_ids, mask=~f.known), pa.array(ends - f.lengths), pa.array(f.lengths), pa.array(crcs, pa.int64())], names=["part", "file", "doc_id", "in_file", "n_tokens", "ids_crc32"])

    return read


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files: start counts the ids of all files before.
    Files are counted by part first, so that one task orders the parts' sums and never the files."""
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids"))
    all_before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(all_before), F.lit(0)).alias("part_start"))
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("file_start")).join(parts, "part")
    spread = files.select("part", "file", "name").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = spread.mapInArrow(_reader(folder), "part long, file long, doc_id long, in_file long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "file"]).select("doc_id", (F.col("part_start") + F.col("file_start") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")


def op10_bitpack(spark, sf_dir: str) -> DataFrame:
    """The digest of every document as it is read back from the files. A null text is empty; see write_files()."""
    return read_files(*write_files(table(spark, sf_dir, "documents")))
