"""Cutting the lineage of iterative jobs, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a session of one process may do without, and gets its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Written:
    """Tables that an iteration writes into the shared folder, all under one root: w(df, name) writes df and reads it again, so
    its lineage ends there, its size is known to the planner, and a lost executor costs a read. drop(name, ...) deletes
    what no later plan reads; what a result reads stays until release()."""

    open: list[Written] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.paths, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", {}, 0
        Written.open.append(self)

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.setdefault(name, []).append(path := f"{self.root}/{self.count}-{name}")
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def only_last(self, name: str) -> None:
        """Deletes the tables of this name but the last."""
        for path in self.paths.get(name, [])[:-1]:
            _remove(self.spark, path)
        self.paths[name] = self.paths.get(name, [])[-1:]

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                _remove(self.spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes every table that is still written; results that read one can then not be read again."""
    while Written.open:
        _remove(spark, Written.open.pop().root)
