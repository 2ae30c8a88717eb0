"""Queries through the data sources: masks as volume files, an image read in slabs, streamlines as points on a grid."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.jobs.trees import DYADIC_SQL, dyadic
from regionframe.operators.granularity import labels_at, spaced
from regionframe.sources.cube import CUBE1_SQL, cube1
from regionframe.sources.cut import shared_dir
from regionframe.sources.datasource import reference_space, register
from regionframe.sources.tables import table

QUERIES, ORACLES = {}, {}
IJK = ["i", "j", "k"]
AFFINE = [2.0, 0, 0, -10, 0, 2, 0, 5, 0, 0, 2, 0]


def written(rows: DataFrame, kind: str, **options: str) -> str:
    """The folder of the files written from rows by their name, in the shared folder."""
    register(rows.sparkSession)
    folder = f"{shared_dir(rows.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    w = rows.repartition("name").write.format(kind).mode("append").option("affine", ",".join(map(str, AFFINE)))
    w.options(**options).save(folder)
    return folder


def mask_volume_file(spark, sf_dir):
    """The voxels whose mean is above 0, written as a mask of bytes and read back: its voxels."""
    m = cube1(spark, sf_dir).groupBy(*IJK).agg(F.avg("x").alias("x"))
    folder = written(m.select(F.lit("mask").alias("name"), *IJK, (F.col("x") > 0).cast("double").alias("x")), "volume", shape="4,4,4", mask="true")
    return spark.read.format("volume").load(folder).where("x <> 0").select(*IJK)


def slab_volume(spark, sf_dir):
    """The sum image, written uncompressed and read in slabs of 320 bytes: each voxel, and the slabs that it was read in."""
    s = cube1(spark, sf_dir).groupBy(*IJK).agg(F.sum(F.round(F.col("x") * 65536)).alias("x"))
    folder = written(s.select(F.lit("sum").alias("name"), *IJK, "x"), "volume", shape="4,4,4", compressed="false")
    cells = spark.read.format("volume").option("slab", 320).load(folder).withColumn("slab", F.spark_partition_id())
    slabs = cells.groupBy().agg(F.count_distinct("slab").alias("slabs"))
    return cells.crossJoin(slabs).select(*IJK, F.col("x").cast("long").alias("x"), "slabs")


def streamlines(spark, sf_dir) -> DataFrame:
    """(name, line, vertex, x, y, z): a vector's components in threes are the vertices of a line, moved onto a grid of 16 steps an
    axis in scanner space; ten files."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v")).where("p < 63")
    step = F.floor((F.col("v").cast("double") + 1) * 8)
    e = e.groupBy("vec_id", F.expr("cast(p div 3 as int)").alias("vertex")).agg(*[F.max(F.when(F.col("p") % 3 == a, step)).alias(c) for a, c in enumerate("xyz")])
    place = lambda c, a: (AFFINE[4 * a + a] * F.col(c) + AFFINE[4 * a + 3]).alias(c)
    return e.select(F.concat(F.lit("lines"), F.col("vec_id") % 10).alias("name"), F.col("vec_id").alias("line"), "vertex", *[place(c, a) for a, c in enumerate("xyz")])


def track_points(spark, sf_dir):
    """Streamlines written as track files and read back as points; the space comes from the header of one of the files; voxels of
    that grid with their number of vertices."""
    folder = written(streamlines(spark, sf_dir), "tracks", shape="17,17,17")
    points = spark.read.format("tracks").load(folder)
    space = reference_space(spark, f"{folder}/lines0.trk").select("affine")
    at = points.crossJoin(space)
    place = lambda c, a: F.rint((F.col(c) - F.get("affine", F.lit(4 * a + 3))) / F.get("affine", F.lit(5 * a))).cast("int")
    return at.select(*[place(c, a).alias(n) for a, (c, n) in enumerate(zip("xyz", IJK, strict=True))]).groupBy(*IJK).agg(F.count("*").alias("vertices"))


def granularity_volume_file(spark, sf_dir, volumes: int = 5):
    """Each voxel's region when 1 to all regions are left, in geometric steps, as one file of volumes in a row; read back."""
    places = cube1(spark, sf_dir).select(F.col("pos").alias("leaf"), *IJK).distinct()
    regions = spaced(voxels := places.count(), volumes)
    labels = labels_at(dyadic(spark, sf_dir).select("node", "parent"), regions, voxels).join(places, "leaf")
    rows = labels.select(F.lit("labels").alias("name"), *IJK, "t", F.col("label").cast("double").alias("x"))
    folder = written(rows, "volume", shape=f"4,4,4,{len(regions)}")
    return spark.read.format("volume").load(folder).select(*IJK, "t", F.col("x").cast("long").alias("label"))


QUERIES |= {"granularity_volume_file": granularity_volume_file, "mask_volume_file": mask_volume_file, "slab_volume": slab_volume, "track_points": track_points}
ORACLES["mask_volume_file"] = f"with {CUBE1_SQL} select i, j, k from cube1 group by all having avg(x) > 0"
ORACLES["slab_volume"] = f"with {CUBE1_SQL} select i, j, k, cast(sum(round(x * 65536)) as bigint) as x, cast(3 as bigint) as slabs from cube1 group by all"
ORACLES["track_points"] = """with e as (select vec_id, p // 3 as vertex, p % 3 as axis, cast(floor((cast(embedding[p + 1] as double) + 1) * 8) as int) as v from embeddings, unnest(range(0, 63)) r(p)),
t as (select max(v) filter (axis = 0) as i, max(v) filter (axis = 1) as j, max(v) filter (axis = 2) as k from e group by vec_id, vertex)
select i, j, k, count(*) as vertices from t group by all"""
ORACLES["granularity_volume_file"] = f"""with {DYADIC_SQL},
w as (select cast(t as int) as t, 64 - cast(round(power(64, t / 4)) as bigint) as step from unnest(range(0, 5)) r(t))
select cast(leaf // 16 as int) as i, cast(leaf // 4 % 4 as int) as j, cast(leaf % 4 as int) as k, t, cast(node + 1 as bigint) as label
from closure join tree on tree.node = closure.ancestor, w where greatest(0, node - 63) <= step and (parent is null or parent - 63 > step)"""
