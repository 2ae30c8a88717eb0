"""Voxel-based analysis of the regression: r² of every voxel under dealt covariates, its largest-value null, threshold, mask,
p-values and cluster enhancement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.functions.linalg import safe_div
from regionframe.jobs.inference import enhanced
from regionframe.jobs.permutation import ALPHA, SEEDS, alpha_allowed, with_p
from regionframe.jobs.regress import permutation_map
from regionframe.operators.enhance import enhanced as enhanced_in_blocks
from regionframe.operators.regression import subjects
from regionframe.sources.cube import CUBE1_SQL, cube1
from regionframe.sources.cut import cut

QUERIES, ORACLES = {}, {}
IJK = ["i", "j", "k"]


def dealt(x: DataFrame, seeds: int) -> DataFrame:
    """(sbj, xs): the subject's covariate as it is (place 0) and as each seed's permutation deals it."""
    moved = permutation_map(x, seeds).join(x.select(F.col("sbj").alias("taken"), "x"), "taken").select("sbj", "seed", "x")
    every = moved.unionByName(x.select("sbj", F.lit(0).cast("long").alias("seed"), "x"))
    return every.groupBy("sbj").agg(F.transform(F.array_sort(F.collect_list(F.struct("seed", "x"))), lambda m: m["x"]).alias("xs"))


def permuted_r2(spark, sf_dir, seeds: int = SEEDS) -> DataFrame:
    """(perm, i, j, k, r2) of the regression on bias and covariate. The cube is joined once; its rows are dealt out to the seeds
    straight into partial sums, and the engine's own moments keep their digits."""
    c = cube1(spark, sf_dir).select("sbj", *IJK, F.col("x").alias("y")).join(dealt(subjects(spark, sf_dir).select("sbj", "x"), seeds), "sbj")
    c = c.select(*IJK, "y", F.posexplode("xs").alias("perm", "x"))
    m = c.groupBy("perm", *IJK).agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    return m.select("perm", *IJK, safe_div(F.col("xy") * F.col("xy"), F.col("xx") * F.col("yy")).alias("r2"))


PERM_R2_SQL = f"""{CUBE1_SQL}, own as (select seed, vec_id as sbj, row_number() over (partition by seed order by vec_id) as r from embeddings, unnest(range(1, {SEEDS + 1})) s(seed)),
deal as (select seed, vec_id as taken, label, row_number() over (partition by seed order by md5(seed || ':' || vec_id), vec_id) as r from embeddings, unnest(range(1, {SEEDS + 1})) s(seed)),
px as (select cast(0 as int) as perm, vec_id as sbj, cast(label as double) as x from embeddings union all
  select cast(own.seed as int), own.sbj, cast(deal.label as double) from own join deal on own.seed = deal.seed and own.r = deal.r),
pr as (select perm, i, j, k, power(corr(c.x, px.x), 2) as r2 from cube1 c join px using (sbj) group by all)"""


def _max(images: DataFrame) -> DataFrame:
    return images.where("perm > 0").groupBy("perm").agg(F.max("r2").alias("max_r2"))


QUERIES["regress_vba_null_max"] = lambda spark, sf_dir: _max(permuted_r2(spark, sf_dir)).select("perm", F.round("max_r2", 7).alias("max_r2"))
ORACLES["regress_vba_null_max"] = f"with {PERM_R2_SQL} select perm, round(max(r2), 7) as max_r2 from pr where perm > 0 group by all"


def regress_vba_threshold(spark, sf_dir, alpha: float = ALPHA):
    alpha_allowed(alpha, SEEDS)
    return _max(permuted_r2(spark, sf_dir)).agg(F.round(F.percentile("max_r2", F.lit(1 - alpha)), 7).alias("threshold"))


QUERIES["regress_vba_threshold"] = regress_vba_threshold
ORACLES["regress_vba_threshold"] = f"with {PERM_R2_SQL}, nm as (select perm, max(r2) as m from pr where perm > 0 group by all) select round(quantile_cont(m, {1 - ALPHA}), 7) as threshold from nm"


def regress_vba_mask(spark, sf_dir):
    """Voxels whose observed r² reaches the threshold of a 60 % error rate, so that some may, with their family-wise p."""
    images = cut(permuted_r2(spark, sf_dir))
    null = _max(images).agg(F.percentile("max_r2", F.lit(0.4)).alias("threshold"), F.collect_list("max_r2").alias("maxima"))  # one value a seed
    return with_p(images.where("perm = 0").crossJoin(F.broadcast(null)).where("r2 >= threshold"), "r2").select(*IJK, F.round("r2", 7).alias("r2"), "p")


QUERIES["regress_vba_mask"] = regress_vba_mask
ORACLES["regress_vba_mask"] = f"""with {PERM_R2_SQL}, nm as (select perm, max(r2) as m from pr where perm > 0 group by all)
select i, j, k, round(r2, 7) as r2, round((1 + (select count(*) from nm where m > pr.r2)) / (select count(*) + 1 from nm), 6) as p from pr where perm = 0 and r2 >= (select quantile_cont(m, 0.4) from nm)"""


def regress_tfce(spark, sf_dir):
    """Every voxel's enhanced r² in the observed image (perm 0) and three permuted ones."""
    e = enhanced(permuted_r2(spark, sf_dir, 3).withColumnRenamed("r2", "t2"))
    return e.select("perm", *IJK, F.round("t2", 7).alias("r2"), F.round("tfce", 8).alias("tfce"))


QUERIES["regress_tfce"] = regress_tfce


def _tfce_sql(seeds: int) -> str:
    """Components at a threshold by labels that sink along edges: on this grid no path is longer than the rounds."""
    return f"""with recursive {PERM_R2_SQL}, top as (select perm, max(r2) / 100 as step from pr where perm <= {seeds} group by all),
lv as materialized (select p.perm, s.n, s.n * t.step as level, t.step, p.i, p.j, p.k, cast(p.i * 16 + p.j * 4 + p.k as int) as v from pr p join top t using (perm), unnest(range(1, 101)) s(n) where p.r2 >= s.n * t.step - 1e-12),
ed as materialized (select a.perm, a.n, a.v as a, b.v as b from lv a join lv b on a.perm = b.perm and a.n = b.n and abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) <= 1),
sink(perm, n, v, label, r) as (select perm, n, v, v, 0 from lv union all
  select s.perm, s.n, e.a, min(s.label), s.r + 1 from sink s join ed e on e.perm = s.perm and e.n = s.n and e.b = s.v where s.r < 32 group by s.perm, s.n, e.a, s.r),
lab as (select perm, n, v, label from sink where r = 32), sz as (select perm, n, label, count(*) as size from lab group by all),
en as (select lv.perm, lv.v, sum(sqrt(sz.size) * lv.level * lv.level * lv.step) as tfce from lv join lab using (perm, n, v) join sz using (perm, n, label) group by all),
full_ as (select pr.perm, i, j, k, r2, coalesce(tfce, 0) as tfce from pr left join en on en.perm = pr.perm and en.v = i * 16 + j * 4 + k)"""


_TFCE_SELECT = "select perm, i, j, k, round(r2, 7) as r2, round(tfce, 8) as tfce from full_"
ORACLES["regress_tfce"] = f"{_tfce_sql(3)} {_TFCE_SELECT} where perm <= 3"


def regress_tfce_blocks(spark, sf_dir):
    """As regress_tfce, with the grid cut into eight blocks."""
    e = enhanced_in_blocks(permuted_r2(spark, sf_dir, 3), "r2", edge=2)
    return e.select("perm", *IJK, F.round("r2", 7).alias("r2"), F.round("tfce", 8).alias("tfce"))


QUERIES["regress_tfce_blocks"] = regress_tfce_blocks
ORACLES["regress_tfce_blocks"] = ORACLES["regress_tfce"]


def regress_tfce_p(spark, sf_dir):
    """The observed voxels' family-wise p under the permutations' largest enhanced r²."""
    e = cut(enhanced(permuted_r2(spark, sf_dir).withColumnRenamed("r2", "t2")))
    null = e.where("perm > 0").groupBy("perm").agg(F.max("tfce").alias("top")).agg(F.collect_list("top").alias("tops"))
    return with_p(e.where("perm = 0").crossJoin(F.broadcast(null)), "tfce", "tops").select(*IJK, F.round("tfce", 8).alias("tfce"), "p")


QUERIES["regress_tfce_p"] = regress_tfce_p
ORACLES["regress_tfce_p"] = f"""{_tfce_sql(SEEDS)}, tm as (select perm, max(tfce) as m from full_ where perm between 1 and {SEEDS} group by all)
select i, j, k, round(tfce, 8) as tfce, round((1 + (select count(*) from tm where m > full_.tfce)) / (select count(*) + 1 from tm), 6) as p from full_ where perm = 0"""


def null_histogram(spark, sf_dir, bins: int = 10):
    """The null of the largest r² in bins of equal width from 0 to its largest: how many permutations each holds."""
    null = cut(_max(permuted_r2(spark, sf_dir)))
    top = null.agg(F.max("max_r2").alias("top"))
    bin_ = F.least(F.floor(F.col("max_r2") / F.col("top") * bins), F.lit(bins - 1)).cast("int")
    return null.crossJoin(F.broadcast(top)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("perms"))


QUERIES["null_histogram"] = null_histogram
ORACLES["null_histogram"] = f"with {PERM_R2_SQL}, nm as (select perm, max(r2) as m from pr where perm > 0 group by all) select cast(least(floor(m / (select max(m) from nm) * 10), 9) as int) as bin, count(*) as perms from nm group by all"
