"""Volumes and tracks as data sources: slabs, headers, round trips, failed jobs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionframe.sources.datasource import listed, reference_space, register
from regionframe.sources.volumes import decode_nifti, encode_nifti

AFFINE = "2,0,0,-10,0,2,0,5,0,0,2,0"


@pytest.mark.parametrize("compressed", [True, False])
def test_volume_round_trip(spark, tmp_path, compressed):
    register(spark)
    r = np.random.default_rng(1)
    v = {n: r.normal(size=(3, 4, 5)) for n in ("a", "b")}
    rows = [(n, i, j, k, float(x[i, j, k])) for n, x in v.items() for i, j, k in np.ndindex(3, 4, 5)] + [("c", 1, 1, 1, None)]
    cells = spark.createDataFrame(rows, "name string, i int, j int, k int, x double")
    to = str(tmp_path / "out")
    cells.repartition(3, "name").write.format("volume").option("shape", "3,4,5").option("affine", AFFINE).option("compressed", str(compressed).lower()).mode("append").save(to)
    ending = ".nii.gz" if compressed else ".nii"
    assert sorted(os.listdir(to)) == [f"{n}{ending}" for n in "abc"]
    got = spark.read.format("volume").option("slab", 400).load(to)
    assert got.rdd.getNumPartitions() == (3 if compressed else 9)  # 832 bytes a file in slabs of 400
    back = {(os.path.basename(x.path)[0], x.i, x.j, x.k): x.x for x in got.collect()}
    assert all(back[n, i, j, k] == (v[n][i, j, k] if n in v else 0.0) for n in "abc" for i, j, k in np.ndindex(3, 4, 5)) and len(back) == 180
    head = spark.read.format("volume").option("content", "header").load(f"{to}/a*").collect()
    assert [(list(h.shape), h.affine[:4], h.affine[15]) for h in head] == [([3, 4, 5], [2, 0, 0, -10], 1)]
    cells.where("name = 'a'").repartition(1).write.format("volume").option("shape", "3,4,5").option("mask", "true").mode("overwrite").save(to)
    assert os.listdir(to) == ["a.nii.gz"] and decode_nifti(open(f"{to}/a.nii.gz", "rb").read())[0].tolist() == np.ones((3, 4, 5)).tolist()


def test_three_slabs_are_three_tasks(spark, tmp_path):
    import gzip

    register(spark)
    x = np.arange(4 * 5 * 6 * 2, dtype=float).reshape(4, 5, 6, 2)
    data = gzip.decompress(encode_nifti(x))
    (tmp_path / "t.nii").write_bytes(data)
    df = spark.read.format("volume").option("slab", -(-len(data) // 3)).load(str(tmp_path / "t.nii"))
    parts = df.withColumn("task", F.spark_partition_id()).collect()
    assert {p.task for p in parts} == {0, 1, 2} and all(x[p.i, p.j, p.k, p.t] == p.x for p in parts) and len(parts) == x.size
    (tmp_path / "short.nii").write_bytes(data[:-9])
    with pytest.raises(Exception, match="ends within"):
        spark.read.format("volume").load(str(tmp_path / "short.nii")).collect()


def test_failed_jobs_leave_no_file(spark, tmp_path):
    register(spark)
    rows = spark.createDataFrame([("a", 0, 0, 0, 1.0), ("a", 1, 0, 0, 1.0), ("b", 9, 9, 9, 1.0)], "name string, i int, j int, k int, x double")
    out = lambda df, to: df.write.format("volume").option("shape", "2,2,2").mode("append").save(to)
    for n, bad in enumerate((rows.repartition(2, "name"), spark.range(0, 2, 1, 2).selectExpr("'a' as name", "int(id) as i", "0 as j", "0 as k", "1d as x"))):  # off the grid; a name in two partitions
        to = str(tmp_path / str(n))
        with pytest.raises(Exception):  # noqa: B017
            out(bad, to)
        assert os.listdir(to) == []


def test_tracks(spark, tmp_path):
    register(spark)
    lines = [("p", 0, 0, 1.0, 2.0, 3.0), ("p", 0, 1, -4.0, 5.0, 6.0), ("p", 3, 0, 0.5, 0.25, 9.0), ("q", 0, 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(lines, "name string, line long, vertex int, x double, y double, z double")
    to = str(tmp_path / "t")
    df.repartition(2, "name").write.format("tracks").option("shape", "8,8,8").option("affine", AFFINE).mode("append").save(to)
    got = spark.read.format("tracks").load(to).collect()
    assert sorted((os.path.basename(g.path), g.line, g.vertex, g.x, g.y, g.z) for g in got) == [("p.trk", 0, 0, 1, 2, 3), ("p.trk", 0, 1, -4, 5, 6), ("p.trk", 1, 0, 0.5, 0.25, 9), ("q.trk", 0, 0, 1, 1, 1)]
    space = reference_space(spark, f"{to}/p.trk").first()
    assert list(space["shape"]) == [8, 8, 8] and list(space.affine[:12]) == [float(x) for x in AFFINE.split(",")]
    with pytest.raises(ValueError):
        reference_space(spark, "x.txt")
    with pytest.raises(FileNotFoundError):
        listed(str(tmp_path), (".nii",))
