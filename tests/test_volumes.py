"""Images written and read many a task: no Python group or frame for each of them."""

import numpy as np
from pyspark.sql import functions as F

from regionframe.jobs.volumes import AFFINE, write_volumes
from regionframe.sources.volumes import decode_nifti, read_volumes


def test_many_images_in_few_batches(spark, tmp_path, monkeypatch):
    from regionframe.sources import volumes as module

    monkeypatch.setattr(module, "BATCH_VOXELS", 100)
    r, shape = np.random.default_rng(1), (2, 3, 4)
    v = {f"s{n}": r.normal(size=shape) for n in range(40)}
    rows = [(n, i, j, k, float(x[i, j, k])) for n, x in v.items() for i, j, k in np.ndindex(shape)] + [("hole", 1, 2, 3, None), ("hole", 0, 0, 1, 2.5)]
    cells = spark.createDataFrame(rows, "name string, i int, j int, k int, x double").orderBy(F.rand(3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)  # images run over several batches
    try:
        made = write_volumes(cells, shape, AFFINE, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # a few bytes are still written by all cores
    paths = {x.name: x.path for x in made.collect()}
    assert set(paths) == {*v, "hole"} and made.count() == 41
    assert all((decode_nifti(open(paths[n], "rb").read())[0] == x).all() for n, x in v.items())
    hole = decode_nifti(open(paths["hole"], "rb").read())[0]
    assert hole[0, 0, 1] == 2.5 and np.count_nonzero(hole) == 1
    back = read_volumes(spark, made.select(F.col("name").alias("sbj"), F.lit("x").alias("feat"), "path"), [str(tmp_path)]).collect()
    assert len(back) == 41 * 24 and all(b.x == v[b.sbj][b.i, b.j, b.k] for b in back if b.sbj != "hole")
