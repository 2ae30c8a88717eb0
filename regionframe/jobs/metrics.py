"""Queries on accuracy: sensitivity, specificity, Dice, area under the curve, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionframe.functions.linalg import safe_div
from regionframe.jobs.voxelwise import VOXEL_T2_SQL, voxel_t2
from regionframe.sources.cut import cut
from regionframe.sources.masks import MASKS_SQL, grid, mask_box, mask_pos

QUERIES, ORACLES = {}, {}
IJK = ["i", "j", "k"]


def flags(spark, sf_dir) -> DataFrame:
    """The grid with two flags: t in the target, e in the estimate."""
    t, e = mask_box(spark, sf_dir).withColumn("t", F.lit(1)), mask_pos(spark, sf_dir).withColumn("e", F.lit(1))
    return grid(spark).join(t, IJK, "left").join(e, IJK, "left").select(*IJK, F.col("t").isNotNull().alias("t"), F.col("e").isNotNull().alias("e"))


_FLAGS_SQL = f"{MASKS_SQL}, flags as (select g.i, g.j, g.k, b.i is not null as t, p.i is not null as e from grid g left join mask_box b using (i, j, k) left join mask_pos p using (i, j, k))"


def rates(t="t", e="e"):
    """Aggregates: sensitivity and specificity; null where the target, or all beside it, is empty."""
    t, e = F.col(t), F.col(e)
    return safe_div(F.count_if(t & e), F.count_if(t)).alias("sens"), safe_div(F.count_if(~t & ~e), F.count_if(~t)).alias("spec")


def sens_spec(spark, sf_dir):
    """Over the grid and within its half i < 2; within the target, where no negative is, specificity is null."""
    f = flags(spark, sf_dir)
    out = [f.where(w).agg(*rates()).select(F.lit(n).alias("within"), F.round("sens", 8).alias("sens"), F.round("spec", 8).alias("spec")) for n, w in (("grid", "true"), ("half", "i < 2"), ("target", "t"))]
    return out[0].unionAll(out[1]).unionAll(out[2])


QUERIES["sens_spec"] = sens_spec
_R = "round(count_if(t and e) / nullif(count_if(t), 0), 8) as sens, round(count_if(not t and not e) / nullif(count_if(not t), 0), 8) as spec"
ORACLES["sens_spec"] = f"with {_FLAGS_SQL} select 'grid' as within, {_R} from flags union all select 'half', {_R} from flags where i < 2 union all select 'target', {_R} from flags where t"


def dice_of():
    t, e = F.col("t"), F.col("e")
    return F.coalesce(safe_div(2 * F.count_if(t & e), F.count_if(t) + F.count_if(e)), F.lit(0.0))


QUERIES["dice"] = lambda spark, sf_dir: flags(spark, sf_dir).agg(F.round(dice_of(), 8).alias("dice"))
ORACLES["dice"] = f"with {_FLAGS_SQL} select round(2 * count_if(t and e) / (count_if(t) + count_if(e)), 8) as dice from flags"


def auc(spark, sf_dir):
    """Area under the curve of the voxels' t² for the target, by ranks with ties averaged; below one half it is folded. The
    ranks run over distinct values and their counts, in ranges of the value: whole ranges before count as one."""
    v = voxel_t2(spark, sf_dir).select(*IJK, "t2").join(mask_box(spark, sf_dir).withColumn("t", F.lit(1)), IJK, "left")
    c = v.groupBy("t2").agg(F.count("*").alias("n"), F.count("t").alias("n1"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    c = cut(c.repartitionByRange(parts, "t2").withColumn("part", F.spark_partition_id()))
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = c.groupBy("part").agg(F.sum("n").alias("all")).select("part", F.coalesce(F.sum("all").over(first), F.lit(0)).alias("start"))
    before = Window.partitionBy("part").orderBy("t2").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts, "part").withColumn("rank", F.col("start") + F.col("below") + (F.col("n") + 1) / 2)
    s = c.agg(F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    a = safe_div(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * (F.col("n") - F.col("n1")))
    return s.select(F.round(F.greatest(a, 1 - a), 8).alias("auc"))


QUERIES["auc"] = auc
ORACLES["auc"] = f"""with {VOXEL_T2_SQL}, v as (select round(t2, 6) as x, i < 3 and j < 3 as t from voxel_s),
a as (select avg(case when p.x > q.x then 1.0 when p.x = q.x then 0.5 else 0.0 end) as a from v p, v q where p.t and not q.t)
select round(greatest(a, 1 - a), 8) as auc from a"""


def perf_report(spark, sf_dir):
    t, e = F.col("t"), F.col("e")
    s = flags(spark, sf_dir).agg(*rates(), dice_of().alias("dice"), F.count_if(t & e).alias("hit"), F.count_if(t).alias("of"), F.count_if(~t & ~e).alias("clear"), F.count_if(~t).alias("beside"))
    return s.select(F.format_string("dice %.3f, sens %.3f (%d of %d), spec %.3f (%d of %d)", "dice", "sens", "hit", "of", "spec", "clear", "beside").alias("report"))


QUERIES["perf_report"] = perf_report
ORACLES["perf_report"] = f"""with {_FLAGS_SQL} select printf('dice %.3f, sens %.3f (%d of %d), spec %.3f (%d of %d)', 2 * count_if(t and e) / (count_if(t) + count_if(e)), count_if(t and e) / count_if(t), cast(count_if(t and e) as bigint), cast(count_if(t) as bigint),
count_if(not t and not e) / count_if(not t), cast(count_if(not t and not e) as bigint), cast(count_if(not t) as bigint)) as report from flags"""


def perf_by_strength(spark, sf_dir):
    """Mean sensitivity and specificity by method (by t², by its root) and threshold, over eight targets of eight voxels."""
    v = voxel_t2(spark, sf_dir).select(F.expr("cast((i * 16 + j * 4 + k) div 8 as int)").alias("region"), "t2")
    s = F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0)))).alias("strength")
    v = v.select("region", "t2", s)
    m = v.select("region", "strength", F.explode(F.array(F.struct(F.lit("t2").alias("method"), (F.col("t2") >= F.col("strength")).alias("e")), F.struct(F.lit("root").alias("method"), (F.sqrt("t2") >= F.col("strength")).alias("e")))).alias("m")).select("region", "strength", "m.*")
    hits = m.groupBy("method", "strength", "region").agg(F.count_if("e").alias("hit"), F.count("*").alias("n"))
    all_ = m.groupBy("method", "strength").agg(F.count_if("e").alias("found"), F.count("*").alias("of"))
    r = hits.join(all_, ["method", "strength"])
    spec = ((F.col("of") - F.col("n")) - (F.col("found") - F.col("hit"))) / (F.col("of") - F.col("n"))
    return r.groupBy("method", "strength").agg(F.round(F.avg(F.col("hit") / F.col("n")), 8).alias("sens"), F.round(F.avg(spec), 8).alias("spec"))


QUERIES["perf_by_strength"] = perf_by_strength
ORACLES["perf_by_strength"] = f"""with {VOXEL_T2_SQL}, v as (select pos // 8 as region, round(t2, 6) as t2 from voxel_s),
m as (select method, strength, region, case when method = 't2' then t2 >= strength else sqrt(t2) >= strength end as e from v, (values (0.5::double), (1.0::double), (2.0::double)) s(strength), (values ('t2'), ('root')) w(method)),
r as (select a.method, a.strength, t.region, count_if(e and a.region = t.region) / count_if(a.region = t.region) as sens, count_if(not e and a.region <> t.region) / count_if(a.region <> t.region) as spec
      from m a, (select distinct region from v) t group by all)
select method, strength, round(avg(sens), 8) as sens, round(avg(spec), 8) as spec from r group by all"""
