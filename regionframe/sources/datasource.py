"""Volumes and tracks as Spark data sources: format("volume") and format("tracks"), once register(spark) has named them.

Reading. path is a file, a folder or a pattern, in any store that pyarrow opens; what it names is listed on the driver, the
headers are read by the tasks. Option content="cells" (volume) or "points" (tracks) gives rows of voxels or vertices,
content="header" one row a file, of which only the header is read. An uncompressed volume is read in slabs of about
`slab` bytes (an option; 64 MB), each by a task that seeks to it; a compressed one is streamed by one task, a slab at a time.

Writing. Rows (name, i, j, k, x) become name.nii.gz (name.nii with option compressed=false) in the folder, rows (name,
line, vertex, x, y, z) name.trk. All rows of a name must be in one partition: repartition("name"). Files get their names
when the job is committed; a job that fails leaves none.
"""

from __future__ import annotations

import gzip
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from regionframe.sources.volumes import DTYPES, HEADER, encode_nifti

SLAB, ROWS = 64 << 20, 1 << 16
TRACK_HEADER = 1000  # fixed value: bytes of a track file's header
CELLS = "path string, i int, j int, k int, t int, x double"
POINTS = "path string, line long, vertex int, x double, y double, z double"
SPACE = "path string, shape array<int>, affine array<double>"


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if ":/" not in path:
        return pyarrow.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def listed(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(file, bytes) of what a path, folder or pattern names, in order; names that begin with a dot are unfinished."""
    fs, at = store(path)
    head, tail = posixpath.split(at.rstrip("/"))
    pattern = any(c in tail for c in "*?[")
    found = [fs.get_file_info(at)] if not pattern else []
    if pattern or found[0].type == pyarrow.fs.FileType.Directory:
        found = fs.get_file_info(pyarrow.fs.FileSelector(head if pattern else at, recursive=not pattern))
    from fnmatch import fnmatch

    ok = [f for f in found if f.is_file and f.base_name.endswith(endings) and not f.base_name.startswith(".") and (not pattern or fnmatch(f.base_name, tail))]
    if not ok:
        raise FileNotFoundError(f"{path}: no file ending in {' or '.join(endings)}")
    return sorted((f.path, f.size) for f in ok)


@dataclass(frozen=True)
class Grid:
    """What a volume's header says."""

    order: str
    shape: tuple[int, ...]
    dtype: str
    offset: int
    slope: float
    inter: float
    affine: tuple[float, ...]


def volume_header(raw: bytes) -> Grid:
    order = "<" if struct.unpack_from("<i", raw, 0)[0] == HEADER else ">"
    if struct.unpack_from(f"{order}i", raw, 0)[0] != HEADER:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(f"{order}8h", raw, 40)
    offset, slope, inter = struct.unpack_from(f"{order}3f", raw, 108)
    affine = (*struct.unpack_from(f"{order}12f", raw, 280), 0.0, 0.0, 0.0, 1.0)
    return Grid(order, dim[1 : 1 + dim[0]], f"{order}{DTYPES[struct.unpack_from(f'{order}h', raw, 70)[0]]}", int(offset), slope, inter, affine)


def track_header(raw: bytes) -> tuple[tuple[int, ...], np.ndarray, np.ndarray, int, int]:
    """(shape, affine from places to scanner space, from the file's numbers to scanner space, scalars, properties). The file's
    numbers are places times voxel sizes, from a voxel's corner."""
    shape, sizes = struct.unpack_from("<3h", raw, 6), np.array(struct.unpack_from("<3f", raw, 12))
    affine = np.array(struct.unpack_from("<16f", raw, 440)).reshape(4, 4)
    affine = affine if affine[3, 3] else np.eye(4)  # older files leave it 0
    sizes = np.where(sizes > 0, sizes, 1.0)
    own = np.diag([*1 / sizes, 1.0])
    own[:3, 3] = -0.5
    return shape, affine, affine @ own, struct.unpack_from("<h", raw, 36)[0], struct.unpack_from("<h", raw, 238)[0]


def opened(path: str):
    """The file as a stream, decompressed if its first bytes say so."""
    fs, at = store(path)
    raw = fs.open_input_file(at)
    packed = raw.read(2) == b"\x1f\x8b"
    raw.seek(0)
    return gzip.GzipFile(fileobj=raw) if packed else raw


class Part(InputPartition):
    def __init__(self, path: str, number: int, parts: int) -> None:
        self.path, self.number, self.parts = path, number, parts


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.header, self.slab = options["path"], options.get("content", "cells") == "header", int(options.get("slab", SLAB))

    def partitions(self) -> list[Part]:
        """A slab each for files that can be sought in, which their name tells; others whole."""
        out = []
        for path, size in listed(self.path, (".nii", ".nii.gz")):
            parts = 1 if self.header or path.endswith(".gz") else max(1, -(-size // self.slab))
            out += [Part(path, n, parts) for n in range(parts)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        stream = opened(part.path)
        with stream:
            g = volume_header(stream.read(352))
            if self.header:
                yield pa.record_batch([pa.array([part.path]), pa.array([list(g.shape)], pa.list_(pa.int32())), pa.array([list(g.affine)], pa.list_(pa.float64()))], names=["path", "shape", "affine"])
                return
            voxels, width = int(np.prod(g.shape)), np.dtype(g.dtype).itemsize
            low, high = (voxels * n // part.parts for n in (part.number, part.number + 1))
            stream.seek(g.offset + low * width)
            for at in range(low, high, ROWS):
                n = min(ROWS, high - at)
                data = stream.read(n * width)
                if len(data) < n * width:
                    raise ValueError(f"{part.path} ends within its voxels")
                x = np.frombuffer(data, g.dtype).astype(float)
                place = np.unravel_index(np.arange(at, at + n), (*g.shape, *[1] * (4 - len(g.shape)))[:4], order="F")
                yield pa.record_batch([pa.array([part.path] * n), *[pa.array(c.astype(np.int32)) for c in place], pa.array(x * g.slope + g.inter if g.slope else x)], names=["path", "i", "j", "k", "t", "x"])


class TrackReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.header = options["path"], options.get("content", "points") == "header"

    def partitions(self) -> list[Part]:
        return [Part(path, 0, 1) for path, _ in listed(self.path, (".trk",))]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        """A file's lines follow each other without an index, so one task streams it; it holds one line more than a batch."""
        stream = opened(part.path)
        with stream:
            shape, affine, own, scalars, properties = track_header(stream.read(TRACK_HEADER))
            if self.header:
                yield pa.record_batch([pa.array([part.path]), pa.array([list(shape)], pa.list_(pa.int32())), pa.array([affine.ravel().tolist()], pa.list_(pa.float64()))], names=["path", "shape", "affine"])
                return
            line, held, rows = 0, [], 0
            while len(count := stream.read(4)) == 4:
                n = struct.unpack("<i", count)[0]
                data = stream.read(4 * (n * (3 + scalars) + properties))
                held.append((line, np.frombuffer(data, "<f4", n * (3 + scalars)).reshape(n, 3 + scalars)[:, :3].astype(float)))
                line, rows = line + 1, rows + n
                if rows >= ROWS:
                    yield self.batch(part.path, held, own)
                    held, rows = [], 0
            if held:
                yield self.batch(part.path, held, own)

    @staticmethod
    def batch(path: str, held: list[tuple[int, np.ndarray]], own: np.ndarray) -> pa.RecordBatch:
        xyz = np.concatenate([p for _, p in held]) @ own[:3, :3].T + own[:3, 3]
        lines = np.concatenate([np.full(len(p), n, np.int64) for n, p in held])
        vertex = np.concatenate([np.arange(len(p), dtype=np.int32) for _, p in held])
        return pa.record_batch([pa.array([path] * len(xyz)), pa.array(lines), pa.array(vertex), *map(pa.array, xyz.T)], names=["path", "line", "vertex", "x", "y", "z"])


@dataclass
class Made(WriterCommitMessage):
    files: list[tuple[str, str]]  # where it is, what it becomes


class FileWriter(DataSourceArrowWriter):
    """One file a name of a partition; encode(name's rows) gives its bytes."""

    ending, columns = "", ()

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.folder, self.job = options, options["path"], uuid.uuid4().hex
        fs, at = store(self.folder)
        fs.create_dir(at, recursive=True)
        if overwrite:
            fs.delete_dir_contents(at)

    def encode(self, rows: dict[str, np.ndarray]) -> bytes:
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> Made:
        fs, at = store(self.folder)
        held = [pa.Table.from_batches([b]).select(["name", *self.columns]) for b in batches]
        files: list[tuple[str, str]] = []
        if held:
            rows = pa.concat_tables(held).sort_by("name")
            names = np.array(rows.column("name").to_pylist(), object)
            starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else []
            for n, start in enumerate(starts):
                end = starts[n + 1] if n + 1 < len(starts) else len(names)
                part = rows.slice(start, end - start)
                made = f"{at}/.{self.job}-{uuid.uuid4().hex}"
                with fs.open_output_stream(made) as out:
                    out.write(self.encode({c: part.column(c).to_numpy() for c in self.columns}))
                files.append((made, f"{at}/{names[start]}{self.ending}"))
        return Made(files)

    def commit(self, messages: list[Made | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [to for _, to in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of a name lie in several partitions: repartition by name first")
        fs, _ = store(self.folder)
        for made, to in files:
            fs.move(made, to)
        self.abort([])  # what attempts that were not chosen have left

    def abort(self, messages: list[Made | None]) -> None:
        fs, at = store(self.folder)
        for f in fs.get_file_info(pyarrow.fs.FileSelector(at)):
            if f.base_name.startswith(f".{self.job}-"):
                fs.delete_file(f.path)


class VolumeWriter(FileWriter):
    """Options: shape ("4,4,4", or "4,4,4,9" for rows with a place t as well), affine (twelve or sixteen numbers), mask (true: one
    byte a voxel, whether x is not 0). A task holds a file's volume."""

    columns = ("i", "j", "k", "x")

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.packed = options.get("compressed", "true").lower() == "true"
        self.ending = ".nii.gz" if self.packed else ".nii"
        self.shape = tuple(int(n) for n in options["shape"].split(","))
        self.columns = (*"ijkt"[: len(self.shape)], "x")
        super().__init__(options, overwrite)

    def encode(self, rows: dict[str, np.ndarray]) -> bytes:
        volume = np.zeros(self.shape)
        volume[tuple(rows[c] for c in self.columns[:-1])] = np.nan_to_num(rows["x"].astype(float))
        affine = self.options.get("affine")
        data = encode_nifti(volume != 0 if self.options.get("mask", "false").lower() == "true" else volume, None if affine is None else np.array(affine.split(","), float)[:12].reshape(3, 4))
        return data if self.packed else gzip.decompress(data)


class TrackWriter(FileWriter):
    """Options: shape and affine of the space that the points (in scanner space) lie in."""

    ending, columns = ".trk", ("line", "vertex", "x", "y", "z")

    def encode(self, rows: dict[str, np.ndarray]) -> bytes:
        affine = np.array(self.options["affine"].split(","), float)
        affine = np.vstack([affine[:12].reshape(3, 4), (0, 0, 0, 1)])
        sizes = np.sqrt((affine[:3, :3] ** 2).sum(0))
        head = bytearray(TRACK_HEADER)
        head[:6] = b"TRACK\0"
        struct.pack_into("<3h", head, 6, *map(int, self.options["shape"].split(",")))
        struct.pack_into("<3f", head, 12, *sizes)
        struct.pack_into("<16f", head, 440, *affine.ravel())
        order = np.lexsort((rows["vertex"], rows["line"]))
        line = rows["line"][order]
        places = np.column_stack([rows[c][order] for c in "xyz"]) - affine[:3, 3]
        xyz = ((places @ np.linalg.inv(affine[:3, :3]).T + 0.5) * sizes).astype("<f4")
        starts = np.flatnonzero(np.r_[True, np.diff(line) != 0])
        struct.pack_into("<3i", head, 988, len(starts), 2, TRACK_HEADER)
        parts = np.split(xyz, starts[1:])
        return bytes(head) + b"".join(struct.pack("<i", len(p)) + p.tobytes() for p in parts)


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return SPACE if self.options.get("content", "cells") == "header" else CELLS

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(self.options)

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(self.options, overwrite)


class TrackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracks"

    def schema(self) -> str:
        return SPACE if self.options.get("content", "points") == "header" else POINTS

    def reader(self, schema) -> TrackReader:
        return TrackReader(self.options)

    def writer(self, schema, overwrite: bool) -> TrackWriter:
        return TrackWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VolumeSource)
    spark.dataSource.register(TrackSource)


def reference_space(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, affine) of a volume's or track file's space, from its header; other endings are an error."""
    register(spark)
    for ending, kind in ((".trk", "tracks"), (".nii", "volume"), (".nii.gz", "volume")):
        if path.endswith(ending):
            return spark.read.format(kind).option("content", "header").load(path)
    raise ValueError(f"{path}: neither a volume nor a track file")
