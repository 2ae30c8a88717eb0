"""Mergeable moments of observations with a fixed number of features, as columns.

Kept additively (n, sums s_a, sums of products q_ab with a <= b), so merging is a sum and un-merging a difference; mean and
population covariance are derived at the end. Names: n, s0.., q00, q01, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionframe.functions.linalg import safe_div


def pairs(d: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(d) for b in range(a, d)]


def additive(features: list[Column]) -> list[Column]:
    """Aggregates n, s*, q* over rows of the features."""
    out = [F.count(features[0]).alias("n")]
    out += [F.sum(x).alias(f"s{a}") for a, x in enumerate(features)]
    return out + [F.sum(features[a] * features[b]).alias(f"q{a}{b}") for a, b in pairs(len(features))]


def names(d: int) -> list[str]:
    return ["n", *[f"s{a}" for a in range(d)], *[f"q{a}{b}" for a, b in pairs(d)]]


def merge(stats: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Moments of the union of all rows that share the keys."""
    return stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names(d)])


def unmerge(whole: DataFrame, part: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Moments of what is in `whole` and not in `part`; a whole that is not larger than its part is an error."""
    j = whole.alias("w").join(part.alias("p"), keys)
    n = F.when(F.col("w.n") > F.col("p.n"), F.col("w.n") - F.col("p.n")).otherwise(F.raise_error(F.lit("the whole must have more observations than the part")).cast("long"))
    return j.select(*keys, n.alias("n"), *[(F.col(f"w.{c}") - F.col(f"p.{c}")).alias(c) for c in names(d)[1:]])


def mean(a: int) -> Column:
    return safe_div(F.col(f"s{a}"), F.col("n"))


def cov(a: int, b: int) -> Column:
    a, b = min(a, b), max(a, b)
    return safe_div(F.col(f"q{a}{b}"), F.col("n")) - mean(a) * mean(b)


def derived(stats: DataFrame, keys: list[str], d: int, digits: int = 6) -> DataFrame:
    """keys, n, mu*, cov* (rounded)."""
    return stats.select(*keys, "n", *[F.round(mean(a), digits).alias(f"mu{a}") for a in range(d)], *[F.round(cov(a, b), digits).alias(f"cov{a}{b}") for a, b in pairs(d)])
