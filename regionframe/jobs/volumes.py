"""Volume files as sources and sinks: tasks write one image a group into the shared folder, Spark reads them back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.jobs.trees import dyadic, observed
from regionframe.jobs.voxelwise import VOXEL_T2_SQL, voxel_t2
from regionframe.operators.tree import closure
from regionframe.sources.cube import CUBE1_SQL, cube1
from regionframe.sources.cut import cut, shared_dir
from regionframe.sources.masks import SHAPE
from regionframe.sources.volumes import encode_nifti, read_volumes, write_file

QUERIES, ORACLES = {}, {}
IJK = ["i", "j", "k"]
#: The grid's placement: voxels of two units, moved off the origin.
AFFINE = np.array([[2.0, 0, 0, -10], [0, 2, 0, 5], [0, 0, 2, 0], [0, 0, 0, 1]])


def write_volumes(cells: DataFrame, shape: tuple[int, int, int], affine: np.ndarray, folder: str) -> DataFrame:
    """(name, path): one file for each name of cells (name, i, j, k, x); a task writes one after another, and what it holds
    follows the grid. All cores write, however few bytes the images have. Voxels without a row, or with a null value, are 0."""

    def written(name: str | None, volume: np.ndarray) -> tuple[str | None, str]:
        return name, write_file(folder, f"{name}.nii.gz", encode_nifti(volume, affine))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by name: the image at hand is whole where another name begins."""
        hand, kind = None, pa.schema([("name", pa.string()), ("path", pa.string())])
        for b in batches:
            names, x, done = b["name"].to_numpy(zero_copy_only=False), b["x"].fill_null(0.0).to_numpy(), []
            ijk = [b[c].to_numpy() for c in IJK]
            starts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if lo == hi:
                    continue
                if hand is None or hand[0] != names[lo]:
                    if hand is not None:
                        done.append(written(*hand))
                    hand = (names[lo], np.zeros(shape))
                hand[1][tuple(c[lo:hi] for c in ijk)] = x[lo:hi]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], schema=kind)
        if hand is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in written(*hand)], schema=kind)

    spark = cells.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = cells.select(F.col("name").cast("string").alias("name"), *IJK, F.col("x").cast("double").alias("x")).repartition(tasks, "name")
    return cut(d.sortWithinPartitions("name").mapInArrow(files, "name string, path string"))


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/volumes-{uuid.uuid4().hex}"


def volume_round_trip(spark, sf_dir):
    """Every subject's image written to a file and read back: the mean of each voxel, and how many images it has."""
    folder = _folder(spark)
    cells = cube1(spark, sf_dir).select(F.concat(F.lit("sbj"), F.col("sbj")).alias("name"), *IJK, "x")
    files = write_volumes(cells, SHAPE, AFFINE, folder).select(F.col("name").alias("sbj"), F.lit("x").alias("feat"), "path")
    return read_volumes(spark, files, [folder]).groupBy(*IJK).agg(F.count("*").alias("images"), F.round(F.avg("x"), 8).alias("mean_x"))


QUERIES["volume_round_trip"] = volume_round_trip
ORACLES["volume_round_trip"] = f"with {CUBE1_SQL} select i, j, k, count(*) as images, round(avg(x), 8) as mean_x from cube1 group by all"


def stat_volume_file(spark, sf_dir):
    """The voxels' t² as a volume file: what is read back of it."""
    folder = _folder(spark)
    files = write_volumes(voxel_t2(spark, sf_dir).select(F.lit("t2").alias("name"), *IJK, F.col("t2").alias("x")), SHAPE, AFFINE, folder)
    files = files.select(F.col("name").alias("sbj"), F.lit("stat").alias("feat"), "path")
    return read_volumes(spark, files, [folder]).select(*IJK, F.round("x", 6).alias("t2"))


QUERIES["stat_volume_file"] = stat_volume_file
ORACLES["stat_volume_file"] = f"with {VOXEL_T2_SQL} select i, j, k, round(coalesce(t2, 0), 6) as t2 from voxel_s"


def region_volume_file(spark, sf_dir):
    """The regions after 60 merges of the fixed tree as a volume of labels, one more than the node: what is read back."""
    t, folder = dyadic(spark, sf_dir), _folder(spark)
    made = lambda c: F.greatest(F.lit(0), F.col(c) - 63)
    alive = t.where((made("node") <= 60) & (F.col("parent").isNull() | (made("parent") > 60))).select(F.col("node").alias("ancestor"))
    cells = closure(t.select("node", "parent")).join(alive, "ancestor").select(F.lit("regions").alias("name"), *[F.expr(e).cast("int").alias(c) for c, e in zip(IJK, ("leaf div 16", "leaf div 4 % 4", "leaf % 4"), strict=True)], (F.col("ancestor") + 1).alias("x"))
    files = write_volumes(cells, SHAPE, AFFINE, folder).select(F.col("name").alias("sbj"), F.lit("label").alias("feat"), "path")
    return read_volumes(spark, files, [folder]).select(*IJK, F.col("x").cast("int").alias("label"))


QUERIES["region_volume_file"] = region_volume_file
ORACLES["region_volume_file"] = "select cast(p // 16 as int) as i, cast(p // 4 % 4 as int) as j, cast(p % 4 as int) as k, cast(case when p < 32 then 121 + p // 16 when p < 64 then 121 + p // 16 end as int) as label from unnest(range(0, 64)) r(p)"


def leaf_stat_volume(spark, sf_dir):
    """The statistic of the fixed tree's leaves, at their voxels."""
    s = observed(spark, sf_dir).where("size = 1")
    return s.select(*[F.expr(e).cast("int").alias(c) for c, e in zip(IJK, ("node div 16", "node div 4 % 4", "node % 4"), strict=True)], F.round("f", 5).alias("f"))


QUERIES["leaf_stat_volume"] = leaf_stat_volume
ORACLES["leaf_stat_volume"] = f"with {VOXEL_T2_SQL} select i, j, k, round(t2, 5) as f from voxel_s"
