"""Permutation inference by voxel: label shuffles, the null of the largest statistic, thresholds, masks, p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.functions.linalg import t2_one
from regionframe.jobs.voxelwise import group_moments1
from regionframe.operators.permute import by_digest, by_number, labelled, ranked
from regionframe.sources.cube import CUBE1_SQL, cube1
from regionframe.sources.cut import cut
from regionframe.sources.tables import table

QUERIES, ORACLES = {}, {}
SEEDS, ALPHA = 20, 0.05


def alpha_allowed(alpha: float, seeds: int) -> None:
    """No p is below one over the permutations and one more, so no test can have a smaller error rate."""
    if alpha < 1 / (seeds + 1):
        raise ValueError(f"an error rate of {alpha} needs {round(1 / alpha) - 1} permutations or more, not {seeds}")


def with_p(d: DataFrame, value: str, maxima: str = "maxima") -> DataFrame:
    """d with p, the family-wise p of its value: one and the larger of maxima (an array), over one more than their number. A column
    of its own: in a select that also rounds the value under its name, a lambda would read the rounded one."""
    return d.withColumn("p", F.round((1 + F.size(F.filter(maxima, lambda m: m > F.col(value)))) / (F.size(maxima) + 1), 6))


def _split(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sbj"), (F.col("label") >= 5).cast("int").alias("grp"))


def permuted_t2(spark, sf_dir, seeds: int = SEEDS):
    """(perm, i, j, k, t2) for every seed; perm 0 is the observed split. The subjects' labels of all seeds are one array a
    subject, so the cube is joined once and not copied for each seed before its rows are needed."""
    c = cube1(spark, sf_dir).drop("grp", "label").join(labelled(_split(spark, sf_dir), seeds), "sbj")
    m = group_moments1(c.select("i", "j", "k", "x", F.posexplode("labels").alias("perm", "grp")), ["perm", "i", "j", "k"])
    return m.select("perm", "i", "j", "k", t2_one(*[F.col(n) for n in ("n0", "m0", "v0", "n1", "m1", "v1")]).alias("t2"))


PERM_SQL = f"""{CUBE1_SQL}, split as (select vec_id as sbj, case when label >= 5 then 1 else 0 end as grp from embeddings),
perm_labels as (select cast(0 as int) as perm, sbj, grp from split union all
  select cast(seed as int), sbj, case when row_number() over (partition by seed order by md5(seed || ':' || sbj), sbj) <= (select count(*) from split where grp = 0) then 0 else 1 end
  from split, unnest(range(1, {SEEDS + 1})) s(seed)),
pm as (select p.perm, c.i, c.j, c.k, {", ".join(f"count(x) filter (p.grp = {g}) as n{g}, avg(x) filter (p.grp = {g}) as m{g}, var_pop(x) filter (p.grp = {g}) as v{g}" for g in (0, 1))} from cube1 c join perm_labels p using (sbj) group by all),
pt as (select perm, i, j, k, (m1 - m0) * (m1 - m0) / nullif((n0 * v0 + n1 * v1) / (n0 + n1), 0) * n0 * n1 / (n0 + n1) as t2 from pm)"""


def perm_split(spark, sf_dir):
    return labelled(_split(spark, sf_dir), SEEDS).select("sbj", F.posexplode("labels").alias("perm", "grp"))


QUERIES["perm_split"] = perm_split
ORACLES["perm_split"] = f"with {PERM_SQL} select sbj, perm, grp from perm_labels"


def perm_matrix_sums(spark, sf_dir):
    """Row and column sums of each seed's permutation matrix (from, to): all one."""
    s = _split(spark, sf_dir).select("sbj").crossJoin(F.broadcast(spark.range(1, 6).withColumnRenamed("id", "seed")))
    p = ranked(ranked(s, ["seed"], *by_digest(), "b"), ["seed"], *by_number(), "a")
    rows, cols = p.groupBy("seed", F.col("a").alias("at")).agg(F.count("*").alias("rows")), p.groupBy("seed", F.col("b").alias("at")).agg(F.count("*").alias("cols"))
    return rows.join(cols, ["seed", "at"]).groupBy("seed").agg(F.min("rows").alias("least_row"), F.max("rows").alias("most_row"), F.min("cols").alias("least_col"), F.max("cols").alias("most_col"), F.count("*").alias("dim"))


QUERIES["perm_matrix_sums"] = perm_matrix_sums
ORACLES["perm_matrix_sums"] = "select seed, cast(1 as bigint) as least_row, cast(1 as bigint) as most_row, cast(1 as bigint) as least_col, cast(1 as bigint) as most_col, (select count(*) from embeddings) as dim from unnest(range(1, 6)) s(seed)"


def _max(spark, sf_dir):
    return permuted_t2(spark, sf_dir).groupBy("perm").agg(F.max("t2").alias("max_t2"))


QUERIES["vba_null_max"] = lambda spark, sf_dir: _max(spark, sf_dir).where("perm > 0").select("perm", F.round("max_t2", 6).alias("max_t2"))
ORACLES["vba_null_max"] = f"with {PERM_SQL} select perm, round(max(t2), 6) as max_t2 from pt where perm > 0 group by all"


def _threshold(null):
    alpha_allowed(ALPHA, SEEDS)
    return null.where("perm > 0").agg(F.percentile("max_t2", F.lit(1 - ALPHA)).alias("threshold"))


QUERIES["vba_threshold"] = lambda spark, sf_dir: _threshold(_max(spark, sf_dir)).select(F.round("threshold", 6).alias("threshold"))
ORACLES["vba_threshold"] = f"with {PERM_SQL}, nm as (select perm, max(t2) as m from pt where perm > 0 group by all) select round(quantile_cont(m, {1 - ALPHA}), 6) as threshold from nm"


def vba_mask(spark, sf_dir):
    """Voxels whose observed t² reaches the threshold of a 60 % error rate (so that some do), and the rate's threshold."""
    t = cut(permuted_t2(spark, sf_dir))
    null = t.where("perm > 0").groupBy("perm").agg(F.max("t2").alias("max_t2")).agg(F.percentile("max_t2", F.lit(0.4)).alias("threshold"))
    return t.where("perm = 0").crossJoin(F.broadcast(null)).where("t2 >= threshold").select("i", "j", "k", F.round("t2", 6).alias("t2"))


QUERIES["vba_mask"] = vba_mask
ORACLES["vba_mask"] = f"""with {PERM_SQL}, nm as (select perm, max(t2) as m from pt where perm > 0 group by all)
select i, j, k, round(t2, 6) as t2 from pt where perm = 0 and t2 >= (select quantile_cont(m, 0.4) from nm)"""


def voxel_pvalue(spark, sf_dir):
    """Family-wise p of each voxel: one and the null's larger maxima, over one more than their number."""
    t = cut(permuted_t2(spark, sf_dir))
    null = t.where("perm > 0").groupBy("perm").agg(F.max("t2").alias("max_t2"))
    maxima = null.agg(F.collect_list("max_t2").alias("maxima"))  # one value a seed
    return with_p(t.where("perm = 0").crossJoin(F.broadcast(maxima)), "t2").select("i", "j", "k", "p")


QUERIES["voxel_pvalue"] = voxel_pvalue
ORACLES["voxel_pvalue"] = f"""with {PERM_SQL}, nm as (select perm, max(t2) as m from pt where perm > 0 group by all)
select i, j, k, round((1 + (select count(*) from nm where m > pt.t2)) / (select count(*) + 1 from nm), 6) as p from pt where perm = 0"""


def pvalue_included(spark, sf_dir):
    """p of each null maximum against the null that holds it: one less those not above it, itself aside, over all."""
    null = cut(_max(spark, sf_dir).where("perm > 0"))
    maxima = null.agg(F.collect_list("max_t2").alias("maxima"))
    p = 1 - (F.size(F.filter("maxima", lambda m: m <= F.col("max_t2"))) - 1) / F.size("maxima")
    return null.crossJoin(F.broadcast(maxima)).select("perm", F.round(p, 6).alias("p"))


QUERIES["pvalue_included"] = pvalue_included
ORACLES["pvalue_included"] = f"""with {PERM_SQL}, nm as (select perm, max(t2) as m from pt where perm > 0 group by all)
select perm, round(1 - ((select count(*) from nm b where b.m <= a.m) - 1) / (select count(*) from nm), 6) as p from nm a"""
