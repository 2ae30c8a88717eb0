"""What the corpus operators share: tables, staged tables, small helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only a session of one process may do without."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a shared folder")
        spark.sparkContext.setCheckpointDir(at := tempfile.mkdtemp(prefix="spark-shared-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark writes to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Stages:
    """The tables that one call of an operator writes into the shared folder, all under one root.

    stage(df, name) writes df as Parquet and reads it again: its lineage ends there, and a lost executor costs a read.
    drop(name, ...) deletes tables that no later plan reads. What the operator's result reads stays until release().
    """

    open: list[Stages] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.at = spark, f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}", {}
        Stages.open.append(self)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        number = sum(map(len, self.at.values()))
        self.at.setdefault(name, []).append(path := f"{self.root}/{number}-{name}")
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.at.pop(name, []):
                remove(self.spark, path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Deletes what operators have staged since the first `keep` calls. Their results can no longer be read, so write
    those first."""
    while len(Stages.open) > keep:
        remove(spark, Stages.open.pop().root)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df staged by itself."""
    return Stages(df.sparkSession, name)(df, name)


def text_of(col: str | Column = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
