"""Queries on regression: fits, contrasts, nuisance, Freedman-Lane, covariates, planted effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.functions.linalg import safe_div
from regionframe.operators.permute import by_digest, by_number, ranked
from regionframe.operators.regression import fit_sql, fitted, subjects
from regionframe.sources.cube import CUBE1_SQL, cube1

QUERIES, ORACLES = {}, {}


def _y(spark, sf_dir) -> DataFrame:
    return cube1(spark, sf_dir).select("pos", "sbj", F.col("x").alias("y"), F.lit(0.0).alias("spatial"))


_FIT_SQL = f"""{CUBE1_SQL}, sy as (select pos as key, sbj, x as y, 0.0::double as spatial from cube1), sx as (select vec_id as sbj, cast(label as double) as x from embeddings), {fit_sql("fit", "sy", "sx")}"""


QUERIES["regress_beta"] = lambda spark, sf_dir: fitted(_y(spark, sf_dir), subjects(spark, sf_dir), ["pos"], 1).select("pos", "n", F.round("b0", 8).alias("b0"), F.round("b1", 8).alias("b1"))
ORACLES["regress_beta"] = f"with {_FIT_SQL} select key as pos, n, round(b0, 8) as b0, round(b1, 8) as b1 from fit"
QUERIES["regress_r2"] = lambda spark, sf_dir: fitted(_y(spark, sf_dir), subjects(spark, sf_dir), ["pos"], 1).select("pos", F.round("r2", 8).alias("r2"), F.round("f", 5).alias("f"))
ORACLES["regress_r2"] = f"with {_FIT_SQL} select key as pos, round(r2, 8) as r2, round(f, 5) as f from fit"


def regress_region(spark, sf_dir):
    """Regions of eight voxels: subjects' means as the image feature, the spatial variance pooled over subjects."""
    y = cube1(spark, sf_dir).groupBy(F.expr("cast(pos div 8 as int)").alias("region"), "sbj").agg(F.avg("x").alias("y"), F.var_pop("x").alias("spatial"))
    return fitted(y, subjects(spark, sf_dir), ["region"], 8).select("region", F.round("b1", 8).alias("b1"), F.round("r2", 8).alias("r2"), F.round("f", 4).alias("f"))


QUERIES["regress_region"] = regress_region
ORACLES["regress_region"] = f"""with {CUBE1_SQL}, sy as (select cast(pos // 8 as int) as key, sbj, avg(x) as y, var_pop(x) as spatial from cube1 group by all), sx as (select vec_id as sbj, cast(label as double) as x from embeddings), {fit_sql("fit", "sy", "sx", 8)}
select key as region, round(b1, 8) as b1, round(r2, 8) as r2, round(f, 4) as f from fit"""


def contrast_fit(y: DataFrame, x: DataFrame, keys: list[str]) -> DataFrame:
    """Bias and x as targets, z as nuisance: keys, b0, b1, bz, r2 after z's part is taken from y. Centred sums solve the
    two slopes; the error and the variance follow from the same sums, so y is read once."""
    j = y.join(x, "sbj")
    m = lambda a: F.avg(a).alias(f"m_{a}")
    c = lambda a, b: F.covar_pop(a, b).alias(f"c_{a}{b}")
    s = j.groupBy(*keys).agg(m("x"), m("z"), m("y"), c("x", "x"), c("x", "z"), c("z", "z"), c("x", "y"), c("z", "y"), c("y", "y"))
    g = {k: F.col(f"c_{k}") for k in ("xx", "xz", "zz", "xy", "zy", "yy")}
    det = g["xx"] * g["zz"] - g["xz"] * g["xz"]
    s = s.withColumns({"b1": safe_div(g["xy"] * g["zz"] - g["zy"] * g["xz"], det), "bz": safe_div(g["zy"] * g["xx"] - g["xy"] * g["xz"], det)})
    s = s.withColumn("b0", F.col("m_y") - F.col("b1") * F.col("m_x") - F.col("bz") * F.col("m_z"))
    b1, bz = F.col("b1"), F.col("bz")
    mse = g["yy"] - b1 * g["xy"] - bz * g["zy"]
    var = g["yy"] - 2 * bz * g["zy"] + bz * bz * g["zz"]
    return s.select(*keys, "b0", "b1", "bz", (1 - safe_div(mse, var)).alias("r2"))


def regress_contrast(spark, sf_dir):
    f = contrast_fit(_y(spark, sf_dir), subjects(spark, sf_dir), ["pos"])
    return f.select("pos", *[F.round(c, 8).alias(c) for c in ("b0", "b1", "bz", "r2")])


QUERIES["regress_contrast"] = regress_contrast
ORACLES["regress_contrast"] = f"""with {CUBE1_SQL}, j as (select c.pos, c.x as y, cast(e.label as double) as x, cast(e.vec_id % 7 as double) as z from cube1 c join embeddings e on e.vec_id = c.sbj),
s as (select pos, avg(x) as mx, avg(z) as mz, avg(y) as my, var_pop(x) as xx, var_pop(z) as zz, covar_pop(x, z) as xz, covar_pop(x, y) as xy, covar_pop(z, y) as zy from j group by pos),
b as (select *, (xy * zz - zy * xz) / (xx * zz - xz * xz) as b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) as bz from s),
e as (select j.pos, avg(power(y - (my - b1 * mx - bz * mz) - b1 * x - bz * z, 2)) as mse, var_pop(y - bz * z) as v from j join b on b.pos = j.pos group by j.pos)
select b.pos, round(my - b1 * mx - bz * mz, 8) as b0, round(b1, 8) as b1, round(bz, 8) as bz, round(1 - mse / v, 8) as r2 from b join e on e.pos = b.pos"""


def nuisance_parts(y: DataFrame, x: DataFrame) -> DataFrame:
    """(pos, sbj, y, effect, resid): the regression on z alone, without bias, split into its effect and the rest."""
    j = y.join(x, "sbj")
    g = j.groupBy("pos").agg(safe_div(F.sum(F.col("z") * F.col("y")), F.sum(F.col("z") * F.col("z"))).alias("gamma"))
    return j.join(g, "pos").select("pos", "sbj", "x", "y", (F.col("gamma") * F.col("z")).alias("effect"), (F.col("y") - F.col("gamma") * F.col("z")).alias("resid"))


def factor_nuisance(spark, sf_dir):
    p = nuisance_parts(_y(spark, sf_dir), subjects(spark, sf_dir))
    return p.groupBy("pos").agg(F.round(F.sum(F.col("effect") * F.col("effect")), 7).alias("ss_effect"), F.round(F.sum(F.col("resid") * F.col("resid")), 7).alias("ss_resid"))


QUERIES["factor_nuisance"] = factor_nuisance
_NUISANCE_SQL = f"""{CUBE1_SQL}, j as (select c.pos, c.sbj, c.x as y, cast(e.label as double) as x, cast(e.vec_id % 7 as double) as z from cube1 c join embeddings e on e.vec_id = c.sbj),
g as (select pos, sum(z * y) / sum(z * z) as gamma from j group by pos),
parts as (select j.pos, sbj, x, y, gamma * z as effect, y - gamma * z as resid from j join g on g.pos = j.pos)"""
ORACLES["factor_nuisance"] = f"with {_NUISANCE_SQL} select pos, round(sum(effect * effect), 7) as ss_effect, round(sum(resid * resid), 7) as ss_resid from parts group by all"


def permutation_map(x: DataFrame, seeds: int) -> DataFrame:
    """(seed, sbj, taken): under a seed, sbj takes the row of `taken`."""
    s = x.select("sbj").crossJoin(F.broadcast(x.sparkSession.range(1, seeds + 1).select(F.col("id").alias("seed"))))
    own = ranked(s, ["seed"], *by_number(), "r")
    to = ranked(s, ["seed"], *by_digest(), "r").withColumnRenamed("sbj", "taken")
    return own.join(to, ["seed", "r"]).drop("r")


def freedman_lane(spark, sf_dir):
    """Slopes on x where the residuals of the nuisance regression are dealt anew and its effect stays."""
    x = subjects(spark, sf_dir)
    p = nuisance_parts(_y(spark, sf_dir), x)
    moved = p.select("pos", F.col("sbj").alias("taken"), "resid").join(permutation_map(x, 3), "taken")
    y = p.select("pos", "sbj", "effect").join(moved, ["pos", "sbj"]).select("seed", "pos", "sbj", (F.col("effect") + F.col("resid")).alias("y"), F.lit(0.0).alias("spatial"))
    return fitted(y, x, ["seed", "pos"], 1).select("seed", "pos", F.round("b1", 8).alias("b1"), F.round("r2", 8).alias("r2"))


QUERIES["freedman_lane"] = freedman_lane
ORACLES["freedman_lane"] = f"""with {_NUISANCE_SQL}, own as (select seed, vec_id as sbj, row_number() over (partition by seed order by vec_id) as r from embeddings, unnest(range(1, 4)) s(seed)),
dealt as (select seed, vec_id as taken, row_number() over (partition by seed order by md5(seed || ':' || vec_id), vec_id) as r from embeddings, unnest(range(1, 4)) s(seed)),
m as (select own.seed, own.sbj, dealt.taken from own join dealt on own.seed = dealt.seed and own.r = dealt.r),
sy as (select m.seed * 1000 + a.pos as key, m.sbj, a.effect + b.resid as y, 0.0::double as spatial from m join parts a on a.sbj = m.sbj join parts b on b.sbj = m.taken and b.pos = a.pos),
sx as (select vec_id as sbj, cast(label as double) as x from embeddings), {fit_sql("fit", "sy", "sx")}
select key // 1000 as seed, cast(key % 1000 as int) as pos, round(b1, 8) as b1, round(r2, 8) as r2 from fit"""


def poly_features(spark, sf_dir):
    """Second-order covariates: the target's with bias, the nuisance's without."""
    return subjects(spark, sf_dir).select("sbj", F.lit(1.0).alias("one"), "x", (F.col("x") * F.col("x")).alias("x2"), "z", (F.col("z") * F.col("z")).alias("z2"))


QUERIES["poly_features"] = poly_features
ORACLES["poly_features"] = "select vec_id as sbj, 1.0::double as one, cast(label as double) as x, cast(label * label as double) as x2, cast(vec_id % 7 as double) as z, cast((vec_id % 7) * (vec_id % 7) as double) as z2 from embeddings"


def sbj_linspace(spark, sf_dir, n: int = 100):
    """x from its least to its largest in equal steps, z at its mean."""
    s = subjects(spark, sf_dir).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("z").alias("z"))
    return s.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step"), "lo", "hi", "z").select("step", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / (n - 1), 8).alias("x"), F.round("z", 8).alias("z"))


QUERIES["sbj_linspace"] = sbj_linspace
ORACLES["sbj_linspace"] = "with s as (select min(label) as lo, max(label) as hi, avg(vec_id % 7) as z from embeddings) select cast(t as int) as step, round(lo + (hi - lo) * cast(t as double) / 99, 8) as x, round(z, 8) as z from s, unnest(range(0, 100)) r(t)"

_CORNER = "i < 2 and j < 2 and k < 2"


def effect_from_t2(spark, sf_dir):
    """Shift of group 1 in the observed direction that gives the wanted t² (without a sample-size factor), by closed form."""
    g = cube1(spark, sf_dir).where(_CORNER).groupBy().agg(*[f(F.when(F.col("grp") == g, F.col("x"))).alias(f"{n}{g}") for g in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    d, v = F.col("m1") - F.col("m0"), safe_div(F.col("n0") * F.col("v0") + F.col("n1") * F.col("v1"), F.col("n0") + F.col("n1"))
    g = g.select(d.alias("d"), v.alias("v"), F.explode(F.array(*map(F.lit, (0.1, 0.5, 1.0)))).alias("t2"))
    return g.select("t2", F.round(F.col("d") * F.sqrt(safe_div(F.col("t2"), safe_div(F.col("d") * F.col("d"), F.col("v")))), 8).alias("delta"))


QUERIES["effect_from_t2"] = effect_from_t2
ORACLES["effect_from_t2"] = f"""with {CUBE1_SQL}, g as (select {", ".join(f"count(x) filter (grp = {g}) as n{g}, avg(x) filter (grp = {g}) as m{g}, var_pop(x) filter (grp = {g}) as v{g}" for g in (0, 1))} from cube1 where {_CORNER})
select t2, round(sign(m1 - m0) * sqrt(t2 * (n0 * v0 + n1 * v1) / (n0 + n1)), 8) as delta from g, (values (0.1::double), (0.5::double), (1.0::double)) t(t2)"""


def _region_fit(spark, sf_dir):
    """One row: sums of the corner's subject means y, of its fit p = b0 + b1 x, and the pooled spatial variance."""
    y = cube1(spark, sf_dir).where(_CORNER).groupBy("sbj").agg(F.avg("x").alias("y"), F.var_pop("x").alias("spatial"))
    x = subjects(spark, sf_dir)
    f = fitted(y.withColumn("all", F.lit(0)), x, ["all"], 8).select("b0", "b1")
    j = y.join(x, "sbj").crossJoin(F.broadcast(f)).withColumn("p", F.col("b0") + F.col("b1") * F.col("x"))
    return j.agg(F.avg(F.col("y") * F.col("y")).alias("c"), F.avg("spatial").alias("tp"), F.var_pop("y").alias("yy"), F.covar_pop("y", "p").alias("yp"), F.var_pop("p").alias("pp"), F.first("b1").alias("b1"))


def effect_from_r2(spark, sf_dir):
    """How far the observed slopes must be stretched for the wanted r²: the positive root of a quadratic."""
    g = _region_fit(spark, sf_dir).select("*", F.explode(F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("r2"))
    want = (F.col("c") + F.col("tp")) / (1 - F.col("r2")) - F.col("tp")
    root = (-F.col("yp") + F.sqrt(F.col("yp") * F.col("yp") + F.col("pp") * (want - F.col("yy")))) / F.col("pp")
    g = g.withColumn("s", root)
    reached = 1 - (F.col("c") + F.col("tp")) / (F.col("yy") + 2 * F.col("s") * F.col("yp") + F.col("s") * F.col("s") * F.col("pp") + F.col("tp"))
    return g.select("r2", F.round("s", 4).alias("stretch"), F.round(reached, 8).alias("reached"))


QUERIES["effect_from_r2"] = effect_from_r2
_REGION_SQL = f"""{CUBE1_SQL}, y as (select sbj, avg(x) as y, var_pop(x) as spatial from cube1 where {_CORNER} group by sbj),
jx as (select y.*, cast(e.label as double) as x from y join embeddings e on e.vec_id = y.sbj),
b as (select regr_slope(y, x) as b1, regr_intercept(y, x) as b0 from jx),
q as (select avg(y * y) as c, avg(spatial) as tp, var_pop(y) as yy, covar_pop(y, b0 + b1 * x) as yp, var_pop(b0 + b1 * x) as pp, any_value(b1) as b1 from jx, b)"""
ORACLES["effect_from_r2"] = f"""with {_REGION_SQL}, s as (select r2, c, tp, yy, yp, pp, (-yp + sqrt(yp * yp + pp * ((c + tp) / (1 - r2) - tp - yy))) / pp as s from q, (values (0.1::double), (0.5::double), (0.9::double)) t(r2))
select r2, round(s, 4) as stretch, round(1 - (c + tp) / (yy + 2 * s * yp + s * s * pp + tp), 8) as reached from s"""


def effect_regress_offset(spark, sf_dir):
    """The planted offset of each subject, x times the slope for r² = 0.5, at the corner's voxels."""
    s = _region_fit(spark, sf_dir).withColumn("r2", F.lit(0.5))
    want = (F.col("c") + F.col("tp")) / (1 - F.col("r2")) - F.col("tp")
    slope = s.select(((-F.col("yp") + F.sqrt(F.col("yp") * F.col("yp") + F.col("pp") * (want - F.col("yy")))) / F.col("pp") * F.col("b1")).alias("slope"))
    v = cube1(spark, sf_dir).where(_CORNER).select("i", "j", "k").distinct()
    return subjects(spark, sf_dir).crossJoin(F.broadcast(slope)).crossJoin(F.broadcast(v)).select("sbj", "i", "j", "k", (F.round(F.col("x") * F.col("slope"), 6) + 0.0).alias("offset"))


QUERIES["effect_regress_offset"] = effect_regress_offset
ORACLES["effect_regress_offset"] = f"""with {_REGION_SQL}, s as (select (-yp + sqrt(yp * yp + pp * ((c + tp) / 0.5 - tp - yy))) / pp * b1 as slope from q), v as (select distinct i, j, k from cube1 where {_CORNER})
select vec_id as sbj, i, j, k, round(label * slope, 6) + 0.0 as "offset" from embeddings, s, v"""
