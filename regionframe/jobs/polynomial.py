"""Polynomial covariates of any order, with or without interactions, their names and their sweep; random directions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionframe.operators.regression import subjects

QUERIES, ORACLES = {}, {}


def terms(names: list[str], order: int, bias: bool, interaction_only: bool = False) -> list[tuple[str, ...]]:
    """The products of covariates by degree, then in order of the names; the empty product is the bias."""
    of = combinations if interaction_only else combinations_with_replacement
    return [t for degree in range(0 if bias else 1, order + 1) for t in of(names, degree)]


def name_of(term: tuple[str, ...]) -> str:
    """1, x, x^2, x z and so on."""
    powers = [(n, term.count(n)) for n in dict.fromkeys(term)]
    return " ".join(n if p == 1 else f"{n}^{p}" for n, p in powers) or "1"


def value_of(term: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a * b, [F.col(n) for n in term], F.lit(1.0))


def expanded(df: DataFrame, names: list[str], order: int, bias: bool, interaction_only: bool = False) -> DataFrame:
    """df (sbj, names) as rows (sbj, place, term, value), a row a term."""
    rows = [F.struct(F.lit(i).alias("place"), F.lit(name_of(t)).alias("term"), value_of(t).alias("value")) for i, t in enumerate(terms(names, order, bias, interaction_only))]
    return df.select("sbj", F.explode(F.array(*rows)).alias("t")).select("sbj", "t.*")


QUERIES["poly_expand"] = lambda spark, sf_dir: expanded(subjects(spark, sf_dir), ["x", "z"], 3, True)
ORACLES["poly_expand"] = """with s as (select vec_id as sbj, cast(label as double) as x, cast(vec_id % 7 as double) as z from embeddings)
select sbj, cast(t.place as int) as place, t.term, t.value from (select sbj, unnest([{'place': 0, 'term': '1', 'value': 1.0::double}, {'place': 1, 'term': 'x', 'value': x}, {'place': 2, 'term': 'z', 'value': z}, {'place': 3, 'term': 'x^2', 'value': x * x},
 {'place': 4, 'term': 'x z', 'value': x * z}, {'place': 5, 'term': 'z^2', 'value': z * z}, {'place': 6, 'term': 'x^3', 'value': x * x * x}, {'place': 7, 'term': 'x^2 z', 'value': x * x * z}, {'place': 8, 'term': 'x z^2', 'value': x * z * z}, {'place': 9, 'term': 'z^3', 'value': z * z * z}]) as t from s)"""
QUERIES["poly_interactions"] = lambda spark, sf_dir: expanded(subjects(spark, sf_dir), ["x", "z"], 2, False, True)
ORACLES["poly_interactions"] = """with s as (select vec_id as sbj, cast(label as double) as x, cast(vec_id % 7 as double) as z from embeddings)
select sbj, cast(t.place as int) as place, t.term, t.value from (select sbj, unnest([{'place': 0, 'term': 'x', 'value': x}, {'place': 1, 'term': 'z', 'value': z}, {'place': 2, 'term': 'x z', 'value': x * z}]) as t from s)"""


def poly_linspace(spark, sf_dir, n: int = 50, order: int = 3):
    """The target from its least to its largest value in equal steps, as the polynomial's terms; the nuisance at its mean, and its
    powers those of the mean."""
    s = subjects(spark, sf_dir).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("z").alias("z"))
    s = s.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sbj"), (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("sbj") / (n - 1)).alias("x"), "z")
    both = expanded(s, ["x"], order, True).union(expanded(s, ["z"], order, False))
    return both.select(F.col("sbj").alias("step"), "term", F.round("value", 6).alias("value"))


QUERIES["poly_linspace"] = poly_linspace
ORACLES["poly_linspace"] = """with r as (select min(label) as lo, max(label) as hi, avg(vec_id % 7) as z from embeddings), s as (select cast(t as int) as step, lo + (hi - lo) * cast(t as double) / 49 as x, z from r, unnest(range(0, 50)) q(t))
select step, t.term, round(t.value, 6) as value from (select step, unnest([{'term': '1', 'value': 1.0::double}, {'term': 'x', 'value': x}, {'term': 'x^2', 'value': x * x}, {'term': 'x^3', 'value': x * x * x},
 {'term': 'z', 'value': z}, {'term': 'z^2', 'value': z * z}, {'term': 'z^3', 'value': z * z * z}]) as t from s)"""


def unit_vectors(spark, ids: DataFrame, d: int, seed: int = 7) -> DataFrame:
    """(id, u): a random direction of d dimensions for each id, even over the sphere. Two digests of id, seed and place give each
    component by the polar form of the normal distribution, so reruns agree."""
    part = lambda salt: lambda p: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id"), F.lit(seed), F.lit(salt), p)), 1, 12), 16, 10).cast("double")
    draw = F.transform(F.sequence(F.lit(1), F.lit(d)), lambda p: F.sqrt(-2 * F.ln((part("r")(p) + 1) / (2.0**48 + 1))) * F.cos(2 * F.pi() * part("a")(p) / 2.0**48))
    v = ids.select("id", draw.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.withColumn("norm", norm).select("id", F.transform("v", lambda x: x / F.col("norm")).alias("u"))


def unit_vector_norms(spark, sf_dir):
    """Random directions of three dimensions, one a subject: their lengths, and the first component's sign balance."""
    u = unit_vectors(spark, subjects(spark, sf_dir).select(F.col("sbj").alias("id")), 3)
    norm = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    return u.agg(F.count("*").alias("n"), F.round(F.min(norm), 9).alias("least"), F.round(F.max(norm), 9).alias("most"), (F.abs(F.avg(F.signum(F.col("u")[0]))) < 4 / F.sqrt(F.count("*"))).alias("balanced"))


QUERIES["unit_vector_norms"] = unit_vector_norms
ORACLES["unit_vector_norms"] = "select count(*) as n, 1.0::double as least, 1.0::double as most, true as balanced from embeddings"
