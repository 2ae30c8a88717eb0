"""Queries on any number of features and any design: t² by voxel, contrasts with several targets and nuisances, Freedman-Lane."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.functions import dense
from regionframe.jobs.regress import permutation_map
from regionframe.operators.designs import group_moments, hotelling, products, regressed
from regionframe.sources.cube import CUBE1_SQL, cube1
from regionframe.sources.tables import table

QUERIES, ORACLES = {}, {}
SEEDS = 3
DESIGN = ["one", "x0", "x1", "x2", "z0", "z1"]
CONTRAST = [True, True, True, True, False, False]


def gauss_sql(name: str, source: str, k: int) -> str:
    """The oracle's solver, by elimination: a table `name` of `source` (a0_0 .., b0 .., other columns) with x0 .. and det."""
    out, last = [], source
    for p in range(k):
        less = lambda c, i: f"{c} - a{i}_{p} / a{p}_{p} * "  # noqa: E731, B023
        new = [f"{less(f'a{i}_{j}', i)}a{p}_{j} as a{i}_{j}" for i in range(p + 1, k) for j in range(p + 1, k)] + [f"{less(f'b{i}', i)}b{p} as b{i}" for i in range(p + 1, k)]
        if new:
            out.append(f"{name}_{p} as materialized (select * replace ({', '.join(new)}) from {last})")
            last = f"{name}_{p}"
    for i in reversed(range(k)):
        known = "".join(f" - a{i}_{j} * x{j}" for j in range(i + 1, k))
        out.append(f"{name}_x{i} as materialized (select *, (b{i}{known}) / a{i}_{i} as x{i} from {last})")
        last = f"{name}_x{i}"
    return ", ".join(out) + f", {name} as (select *, {' * '.join(f'a{i}_{i}' for i in range(k))} as det from {last})"


def cube_of(spark, sf_dir, d: int) -> DataFrame:
    """(sbj, pos, x0 .., grp): as many voxels of d features as a vector has room for; feature a is a whole image further on."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sbj"), (F.col("label") >= 5).cast("int").alias("grp"), "embedding", F.expr(f"size(embedding) div {d}").alias("voxels"))
    at = e.select("sbj", "grp", "embedding", "voxels", F.posexplode(F.slice("embedding", F.lit(1), F.col("voxels"))).alias("pos", "x0"))
    return at.select("sbj", "pos", "grp", F.col("x0").cast("double").alias("x0"), *[F.get("embedding", F.col("voxels") * a + F.col("pos")).cast("double").alias(f"x{a}") for a in range(1, d)])


def voxel_t2(d: int):
    def query(spark, sf_dir):
        m = hotelling(group_moments(cube_of(spark, sf_dir, d), ["pos"], [f"x{a}" for a in range(d)]), d)
        return m.select("pos", "rank", F.round(F.log10("det"), 6).alias("log_det"), F.round("t2", 5).alias("t2"), F.round("f", 5).alias("f"))

    return query


def _t2_sql(d: int) -> str:
    moments = ", ".join(f"count(*) filter (grp = {g}) as n{g}, " + ", ".join(f"avg(x{a}) filter (grp = {g}) as m{g}_{a}" for a in range(d)) + ", " + ", ".join(f"covar_pop(x{a}, x{b}) filter (grp = {g}) as c{g}_{a}_{b}" for a in range(d) for b in range(d)) for g in (0, 1))
    pooled = ", ".join([*[f"(n0 * c0_{a}_{b} + n1 * c1_{a}_{b}) / (n0 + n1) as a{a}_{b}" for a in range(d) for b in range(d)], *[f"m1_{a} - m0_{a} as b{a}, m1_{a} - m0_{a} as d{a}" for a in range(d)]])
    features = ", ".join(f"cast(embedding[p + 1 + {a} * v] as double) as x{a}" for a in range(d))
    t2 = "(" + " + ".join(f"d{a} * x{a}" for a in range(d)) + ") * n0 * n1 / (n0 + n1)"
    return f"""with c as (select vec_id, cast(p as int) as pos, case when label >= 5 then 1 else 0 end as grp, {features} from (select *, len(embedding) // {d} as v from embeddings), unnest(range(0, 64 // {d})) r(p)),
m as (select pos, {moments} from c group by pos), q as (select pos, n0, n1, {pooled} from m), {gauss_sql("g", "q", d)}
select pos, {d} as rank, round(log10(det), 6) as log_det, round({t2}, 5) as t2, round({t2} * (n0 + n1 - {d} - 1) / ((n0 + n1 - 2) * {d}), 5) as f from g"""


for _d in (3, 5):
    QUERIES[f"voxel_t2_d{_d}"], ORACLES[f"voxel_t2_d{_d}"] = voxel_t2(_d), _t2_sql(_d)


def voxel_t2_dependent(spark, sf_dir):
    """The singular case: a feature and its double between two others count once."""
    c = cube_of(spark, sf_dir, 2).withColumn("twice", 2 * F.col("x0"))
    m = hotelling(group_moments(c, ["pos"], ["x0", "twice", "x1"]), 3)
    return m.select("pos", "rank", F.round("det", 8).alias("det"), F.round("t2", 5).alias("t2"), F.round("f", 5).alias("f"))


QUERIES["voxel_t2_dependent"] = voxel_t2_dependent
ORACLES["voxel_t2_dependent"] = f"select pos, rank, cast(0 as double) as det, t2, f from ({_t2_sql(2)})"


def covariates(spark, sf_dir) -> DataFrame:
    """(sbj, one, x0, x1, x2, z0, z1): bias, three targets, two nuisances."""
    part = lambda m: (F.col("vec_id") % m).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sbj"), F.lit(1.0).alias("one"), F.col("label").cast("double").alias("x0"), part(5).alias("x1"), part(9).alias("x2"), part(7).alias("z0"), part(11).alias("z1"))


def _images(spark, sf_dir) -> DataFrame:
    return cube1(spark, sf_dir).select("pos", "sbj", F.col("x").alias("y")).join(covariates(spark, sf_dir), "sbj")


def _betas(fit: DataFrame, keys: list[str], k: int) -> DataFrame:
    return fit.select(*keys, *[F.round(F.get("beta", F.lit(i)), 8).alias(f"b{i}") for i in range(k)], F.round("r2", 8).alias("r2"), F.round("f", 5).alias("f"))


def regress_design(spark, sf_dir):
    """Every voxel on six columns, four of them in the contrast."""
    return _betas(regressed(products(_images(spark, sf_dir), ["pos"], DESIGN), CONTRAST), ["pos"], 6)


_COVARIATES_SQL = "cov as (select vec_id as sbj, 1.0::double as c0, cast(label as double) as c1, cast(vec_id % 5 as double) as c2, cast(vec_id % 9 as double) as c3, cast(vec_id % 7 as double) as c4, cast(vec_id % 11 as double) as c5 from embeddings)"


def _fit_sql(name: str, y: str, keys: str) -> str:
    """Fit of `y` (keys, sbj, y) on all columns of cov: a table `name` (keys, x0 .. x5, r2, f)."""
    sums = ", ".join([*[f"sum(c{i} * c{j}) as a{i}_{j}" for i in range(6) for j in range(6)], *[f"sum(c{i} * y) as b{i}" for i in range(6)]])
    fit = " + ".join(f"x{i} * c{i}" for i in range(6))
    using = ", ".join(keys.split(","))
    return f"""{name}_s as (select {using}, count(*) as n, {sums} from {y} join cov using (sbj) group by {using}), {gauss_sql(f"{name}_g", f"{name}_s", 6)},
{name}_e as (select {using}, avg(power(y - ({fit}), 2)) as mse, var_pop(y - x4 * c4 - x5 * c5) as v from {y} join cov using (sbj) join {name}_g using ({using}) group by {using}),
{name} as (select g.*, 1 - mse / v as r2, (1 - mse / v) / (mse / v) * (n - 6) / 5 as f from {name}_g g join {name}_e using ({using}))"""


_OUT = ", ".join(f"round(x{i}, 8) as b{i}" for i in range(6)) + ", round(r2, 8) as r2, round(f, 5) as f"
QUERIES["regress_design"] = regress_design
ORACLES["regress_design"] = f"with {CUBE1_SQL}, {_COVARIATES_SQL}, y as (select pos, sbj, x as y from cube1), {_fit_sql('fit', 'y', 'pos')} select pos, {_OUT} from fit"


def split_by_nuisance(images: DataFrame, nuisance: list[str]) -> DataFrame:
    """images (pos, sbj, y, covariates) with `effect` and `resid`: the regression on the nuisances alone, without bias."""
    k = len(nuisance)
    s = products(images, ["pos"], nuisance)
    gamma = s.select("pos", dense.solve(dense.factor(F.col("xtx"), k), F.col("xty"), k).alias("gamma"))
    effect = dense.dot(F.col("gamma"), dense.vector([F.col(c) for c in nuisance]))
    return images.join(gamma, "pos").withColumn("effect", effect).withColumn("resid", F.col("y") - F.col("effect")).drop("gamma")


def freedman_lane_design(spark, sf_dir):
    """The same fit where the residuals of the nuisance regression are dealt anew under some seeds and its effect stays."""
    parts = split_by_nuisance(_images(spark, sf_dir), ["z0", "z1"])
    moved = parts.select("pos", F.col("sbj").alias("taken"), "resid").join(permutation_map(covariates(spark, sf_dir), SEEDS), "taken").select("seed", "pos", "sbj", "resid")
    y = parts.drop("resid", "y").join(moved, ["pos", "sbj"]).withColumn("y", F.col("effect") + F.col("resid"))
    return _betas(regressed(products(y, ["seed", "pos"], DESIGN), CONTRAST), ["seed", "pos"], 6)


QUERIES["freedman_lane_design"] = freedman_lane_design
ORACLES["freedman_lane_design"] = f"""with {CUBE1_SQL}, {_COVARIATES_SQL},
own as (select seed, vec_id as sbj, row_number() over (partition by seed order by vec_id) as r from embeddings, unnest(range(1, {SEEDS + 1})) s(seed)),
dealt as (select seed, vec_id as taken, row_number() over (partition by seed order by md5(seed || ':' || vec_id), vec_id) as r from embeddings, unnest(range(1, {SEEDS + 1})) s(seed)),
m as (select own.seed, own.sbj, dealt.taken from own join dealt on own.seed = dealt.seed and own.r = dealt.r),
ns as (select pos, sum(c4 * c4) as a0_0, sum(c4 * c5) as a0_1, sum(c4 * c5) as a1_0, sum(c5 * c5) as a1_1, sum(c4 * x) as b0, sum(c5 * x) as b1 from cube1 join cov using (sbj) group by pos), {gauss_sql("ng", "ns", 2)},
parts as (select pos, sbj, x0 * c4 + x1 * c5 as effect, x - x0 * c4 - x1 * c5 as resid from cube1 join cov using (sbj) join ng using (pos)),
y as (select m.seed, a.pos, m.sbj, a.effect + b.resid as y from m join parts a on a.sbj = m.sbj join parts b on b.sbj = m.taken and b.pos = a.pos), {_fit_sql("fit", "y", "seed,pos")}
select cast(seed as bigint) as seed, pos, {_OUT} from fit"""
