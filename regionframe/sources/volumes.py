"""Volume files as frames and back: NIfTI-1 single files (.nii, .nii.gz) and TrackVis vertices (.trk).

Files are read by Spark's binaryFile source, a file a row, and decoded in the tasks; voxels come out as rows.
"""

from __future__ import annotations

import gzip
import struct
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The format's codes of voxel types.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
HEADER = 348
BATCH_VOXELS = 1 << 18  # voxels that a reading task hands on at once


def decode_nifti(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(volume, 4 x 4 affine). Scaling applies where the slope is not 0."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    order = "<" if struct.unpack_from("<i", raw, 0)[0] == HEADER else ">"
    if struct.unpack_from(f"{order}i", raw, 0)[0] != HEADER:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(f"{order}8h", raw, 40)
    code, (offset, slope, inter) = struct.unpack_from(f"{order}h", raw, 70)[0], struct.unpack_from(f"{order}3f", raw, 108)
    shape = dim[1 : 1 + dim[0]]
    volume = np.frombuffer(raw, f"{order}{DTYPES[code]}", int(np.prod(shape)), int(offset)).reshape(shape, order="F").astype(float)
    affine = np.vstack([np.array(struct.unpack_from(f"{order}12f", raw, 280)).reshape(3, 4), (0, 0, 0, 1)])
    return (volume * slope + inter if slope else volume), affine


def encode_nifti(volume: np.ndarray, affine: np.ndarray | None = None) -> bytes:
    """A gzipped file of doubles, or of bytes for a boolean volume."""
    v = volume.astype("u1" if volume.dtype == bool else "<f8")
    head = bytearray(352)
    struct.pack_into("<i", head, 0, HEADER)
    struct.pack_into("<8h", head, 40, v.ndim, *v.shape, *[1] * (7 - v.ndim))
    struct.pack_into("<2h", head, 70, 2 if volume.dtype == bool else 64, v.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, *[1] * 7)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *(np.eye(4) if affine is None else affine)[:3].ravel())
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + v.tobytes(order="F"), mtime=0)


def decode_tracks(data: bytes) -> np.ndarray:
    """All vertices of all streamlines, (n, 3); none in an empty file."""
    scalars, properties = struct.unpack_from("<h", data, 36)[0], struct.unpack_from("<h", data, 238)[0]
    at, out = 1000, []
    while at + 4 <= len(data):
        n = struct.unpack_from("<i", data, at)[0]
        out.append(np.frombuffer(data, "<f4", n * (3 + scalars), at + 4).reshape(n, 3 + scalars)[:, :3])
        at += 4 + 4 * (n * (3 + scalars) + properties)
    return np.concatenate(out).astype(float) if out else np.zeros((0, 3))


def write_file(folder: str, name: str, data: bytes) -> str:
    """Writes a file into a folder of any store that pyarrow knows, under another name until it is whole; its path. An attempt
    that is repeated writes the same."""
    store, at = pyarrow.fs.FileSystem.from_uri(folder) if ":/" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    store.create_dir(at, recursive=True)
    part = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{at}/{name}")
    return f"{folder}/{name}"


def same_space(one: tuple[tuple, np.ndarray], two: tuple[tuple, np.ndarray]) -> bool:
    """Whether two grids (shape, affine) are one: equal shapes, and affines equal up to rounding."""
    return tuple(one[0]) == tuple(two[0]) and np.allclose(one[1], two[1], rtol=1e-5, atol=1e-8)


def spaces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, shape, affine) of the files, from their headers alone."""
    from regionframe.sources.datasource import reference_space

    return reduce(DataFrame.union, [reference_space(spark, p) for p in paths])


def read_volumes(spark: SparkSession, files: DataFrame, paths: list[str]) -> DataFrame:
    """(sbj, feat, i, j, k, x) of the files (sbj, feat, path) that the paths (files, folders or patterns) hold. Files are matched
    by their last name. The first file's grid is that of all: another one raises."""
    first = spark.read.format("binaryFile").load(paths).select("path").agg(F.min("path").alias("path")).first().path
    got = spaces(spark, [first]).first()
    space = (tuple(got.shape), np.array(got.affine).reshape(4, 4))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, known = [c.ravel().astype(np.int32) for c in np.indices(space[0])], set()
        step = max(1, BATCH_VOXELS // max(1, len(grid[0])))
        for b in batches:
            for at in range(0, len(b), step):
                part, values = b.slice(at, step), []
                for path, content in zip(part["path"], part["content"], strict=True):
                    v, affine = decode_nifti(content.as_buffer())
                    if (own := (v.shape, affine.tobytes())) not in known:
                        if not same_space(space, (v.shape, affine)):
                            raise ValueError(f"{path} has another grid than {first}")
                        known.add(own)
                    values.append(v.ravel())
                name = part["name"].take(pa.array(np.repeat(np.arange(len(part)), len(grid[0]))))
                yield pa.RecordBatch.from_arrays([name, *[pa.array(np.tile(c, len(part))) for c in grid], pa.array(np.concatenate(values))], names=["name", "i", "j", "k", "x"])

    name = F.element_at(F.split("path", "/"), -1).alias("name")
    cells = spark.read.format("binaryFile").load(paths).select("path", name, "content").mapInArrow(rows, "name string, i int, j int, k int, x double")
    return cells.join(files.select("sbj", "feat", name), "name").select("sbj", "feat", "i", "j", "k", "x")


def cube_of(volumes: DataFrame, feats: list[str]) -> DataFrame:
    """(i, j, k, sbj, x): features in an array of the given order; voxels where any value of any subject is zero or missing
    are left out."""
    c = volumes.groupBy("i", "j", "k", "sbj").agg(*[F.max(F.when(F.col("feat") == f, F.col("x"))).alias(f"f{n}") for n, f in enumerate(feats)])
    whole = F.lit(True)
    for n in range(len(feats)):
        whole = whole & F.col(f"f{n}").isNotNull() & (F.col(f"f{n}") != 0)
    ok = c.groupBy("i", "j", "k").agg(F.bool_and(whole).alias("ok")).where("ok").drop("ok")
    return c.join(ok, ["i", "j", "k"], "left_semi").select("i", "j", "k", "sbj", F.array(*[f"f{n}" for n in range(len(feats))]).alias("x"))
