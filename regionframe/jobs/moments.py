"""Queries on moments: grouping, merging, un-merging, pooling, scaling, normal fits, determinant and inverse."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionframe.functions.linalg import safe_div
from regionframe.operators import moments as M
from regionframe.sources.tables import table

QUERIES, ORACLES = {}, {}
KEYS = ["l_returnflag", "l_linestatus"]
def _xy():
    return [F.col("l_quantity"), F.col("l_extendedprice")]



def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*KEYS, "l_quantity", "l_extendedprice", "l_linenumber")


def _fs(spark, sf_dir, *keys):
    return _lines(spark, sf_dir).groupBy(*keys).agg(*M.additive(_xy()))


_MU = "count(*) as n, round(avg(l_quantity), 6) as mu0, round(avg(l_extendedprice), 6) as mu1"
_COV = "round(var_pop(l_quantity), 4) as cov00, round(covar_pop(l_quantity, l_extendedprice), 4) as cov01, round(var_pop(l_extendedprice), 2) as cov11"


def _out(stats, keys):
    return stats.select(*keys, "n", F.round(M.mean(0), 6).alias("mu0"), F.round(M.mean(1), 6).alias("mu1"), F.round(M.cov(0, 0), 4).alias("cov00"), F.round(M.cov(0, 1), 4).alias("cov01"), F.round(M.cov(1, 1), 2).alias("cov11"))


def featstat_group(spark, sf_dir):
    return _out(_fs(spark, sf_dir, *KEYS), KEYS)


QUERIES["featstat_group"] = featstat_group
ORACLES["featstat_group"] = f"select l_returnflag, l_linestatus, {_MU}, {_COV} from lineitem group by all"


def featstat_merge(spark, sf_dir):
    """Groups of line numbers, merged to their flags' moments: equal to the moments of all rows."""
    return _out(M.merge(_fs(spark, sf_dir, "l_returnflag", "l_linenumber"), ["l_returnflag"], 2), ["l_returnflag"])


QUERIES["featstat_merge"] = featstat_merge
ORACLES["featstat_merge"] = f"select l_returnflag, {_MU}, {_COV} from lineitem group by all"


def featstat_unmerge(spark, sf_dir):
    """All rows of a flag without those of line number 1."""
    part = _lines(spark, sf_dir).where("l_linenumber = 1").groupBy("l_returnflag").agg(*M.additive(_xy()))
    return _out(M.unmerge(_fs(spark, sf_dir, "l_returnflag"), part, ["l_returnflag"], 2), ["l_returnflag"])


QUERIES["featstat_unmerge"] = featstat_unmerge
ORACLES["featstat_unmerge"] = f"select l_returnflag, {_MU}, {_COV} from lineitem where l_linenumber <> 1 group by all"


def featstat_pool(spark, sf_dir):
    """Covariance pooled over line states, weighted by their sizes."""
    s = _fs(spark, sf_dir, *KEYS)
    c = {ab: F.round(safe_div(F.sum(M.cov(*ab) * F.col("n")), F.sum("n")), d) for ab, d in (((0, 0), 4), ((0, 1), 4), ((1, 1), 2))}
    return s.groupBy("l_returnflag").agg(F.sum("n").alias("n"), *[v.alias(f"cov{a}{b}") for (a, b), v in c.items()])


QUERIES["featstat_pool"] = featstat_pool
ORACLES["featstat_pool"] = """
with g as (select l_returnflag, count(*) as n, var_pop(l_quantity) as a, covar_pop(l_quantity, l_extendedprice) as b, var_pop(l_extendedprice) as c from lineitem group by l_returnflag, l_linestatus)
select l_returnflag, cast(sum(n) as bigint) as n, round(sum(a * n) / sum(n), 4) as cov00, round(sum(b * n) / sum(n), 4) as cov01, round(sum(c * n) / sum(n), 2) as cov11 from g group by all"""


def featstat_scale(spark, sf_dir):
    """Moments of A x from those of x, A = [[2, 0.01], [1, -0.01]]."""
    s, (a, b), (c, d) = _fs(spark, sf_dir, *KEYS), (2.0, 0.01), (1.0, -0.01)
    m, v = (M.mean(0), M.mean(1)), {ab: M.cov(*ab) for ab in M.pairs(2)}
    form = lambda p, q: p[0] * q[0] * v[0, 0] + (p[0] * q[1] + p[1] * q[0]) * v[0, 1] + p[1] * q[1] * v[1, 1]
    return s.select(*KEYS, "n", F.round(a * m[0] + b * m[1], 6).alias("mu0"), F.round(c * m[0] + d * m[1], 6).alias("mu1"), F.round(form((a, b), (a, b)), 3).alias("cov00"), F.round(form((a, b), (c, d)), 3).alias("cov01"), F.round(form((c, d), (c, d)), 3).alias("cov11"))


QUERIES["featstat_scale"] = featstat_scale
ORACLES["featstat_scale"] = """
with y as (select l_returnflag, l_linestatus, 2 * l_quantity + 0.01::double * l_extendedprice as u, l_quantity - 0.01::double * l_extendedprice as v from lineitem)
select l_returnflag, l_linestatus, count(*) as n, round(avg(u), 6) as mu0, round(avg(v), 6) as mu1, round(var_pop(u), 3) as cov00, round(covar_pop(u, v), 3) as cov01, round(var_pop(v), 3) as cov11 from y group by all"""


def featstat_bessel(spark, sf_dir):
    """Normal fit with the sample's covariance."""
    s = _fs(spark, sf_dir, *KEYS)
    k = safe_div(F.col("n"), F.col("n") - 1)
    return s.select(*KEYS, F.round(M.mean(0), 6).alias("mu0"), F.round(M.cov(0, 0) * k, 4).alias("cov00"), F.round(M.cov(0, 1) * k, 4).alias("cov01"))


QUERIES["featstat_bessel"] = featstat_bessel
ORACLES["featstat_bessel"] = "select l_returnflag, l_linestatus, round(avg(l_quantity), 6) as mu0, round(var_samp(l_quantity), 4) as cov00, round(covar_samp(l_quantity, l_extendedprice), 4) as cov01 from lineitem group by all"


def featstat_equal(spark, sf_dir):
    """Whether the merged moments of a flag equal those of all its rows within the usual tolerances."""
    merged, whole = M.merge(_fs(spark, sf_dir, *KEYS), ["l_returnflag"], 2).alias("a"), _fs(spark, sf_dir, "l_returnflag").alias("b")
    close = F.lit(True)
    for c in M.names(2):
        close = close & (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= 1e-8 + 1e-5 * F.abs(F.col(f"b.{c}")))
    return merged.join(whole, "l_returnflag").select("l_returnflag", close.alias("equal"))


QUERIES["featstat_equal"] = featstat_equal
ORACLES["featstat_equal"] = "select distinct l_returnflag, true as equal from lineitem"


def cov_det_inv_d2(spark, sf_dir):
    s = _fs(spark, sf_dir, *KEYS)
    det = M.cov(0, 0) * M.cov(1, 1) - M.cov(0, 1) * M.cov(0, 1)
    inv = lambda x: F.round(safe_div(x, det) * 1e6, 4)
    return s.select(*KEYS, F.round(F.log10(det), 6).alias("log_det"), inv(M.cov(1, 1)).alias("inv00"), inv(-M.cov(0, 1)).alias("inv01"), inv(M.cov(0, 0)).alias("inv11"))


QUERIES["cov_det_inv_d2"] = cov_det_inv_d2
ORACLES["cov_det_inv_d2"] = """
with g as (select l_returnflag, l_linestatus, var_pop(l_quantity) as a, covar_pop(l_quantity, l_extendedprice) as b, var_pop(l_extendedprice) as c from lineitem group by all)
select l_returnflag, l_linestatus, round(log10(a * c - b * b), 6) as log_det, round(c / nullif(a * c - b * b, 0) * 1e6, 4) as inv00, round(-b / nullif(a * c - b * b, 0) * 1e6, 4) as inv01, round(a / nullif(a * c - b * b, 0) * 1e6, 4) as inv11 from g"""


def featstat_events_hourly(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return e.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("m", 6).alias("mu"), F.round("v", 6).alias("cov"))


QUERIES["featstat_events_hourly"] = featstat_events_hourly
ORACLES["featstat_events_hourly"] = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(value) as n, round(avg(value), 6) as mu, round(var_pop(value), 6) as cov from events group by date_trunc('hour', ts), event_type"
