"""Small dense linear algebra as column expressions on array<double>, for any number of rows d that is known when the plan is
made: Cholesky factor, determinant, triangular solves. Nothing leaves the JVM.

A matrix is its d * d entries row by row, a factor its lower triangle row by row. A column of a matrix that depends on the
columns before it (its pivot is below TINY of its own diagonal entry) is singular: its factor entries are 0, so that it
takes no part in solves; the determinant is then 0, and rank() counts the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def matrix(rows: Sequence[Sequence[Column]]) -> Column:
    return F.array(*[x.cast("double") for row in rows for x in row])


def vector(xs: Sequence[Column]) -> Column:
    return F.array(*[x.cast("double") for x in xs])


def _none(kind: str = "double") -> Column:
    return F.array().cast(f"array<{kind}>")


def _row(i: Column) -> Column:
    """Where row i of a factor begins, from 0."""
    return (i * (i + 1) / 2).cast("int")


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def factor(a: Column, d: int) -> Column:
    """The Cholesky factor of a positive semidefinite matrix, entry after entry."""
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(d) for j in range(i + 1)])

    def entry(done: Column, p: Column) -> Column:
        i, j = p["i"], p["j"]
        rest = F.get(a, i * d + j) - dot(F.slice(done, _row(i) + 1, j), F.slice(done, _row(j) + 1, j))
        pivot = F.get(done, _row(j) + j)
        on = F.when(rest > TINY * F.abs(F.get(a, i * d + i)), F.sqrt(F.greatest(rest, F.lit(0.0)))).otherwise(0.0)
        return F.concat(done, F.array(F.when(i == j, on).when(pivot > 0, rest / pivot).otherwise(0.0)))

    return F.aggregate(places, _none(), entry)


def pivots(factor_: Column, d: int) -> Column:
    return F.array(*[F.get(factor_, F.lit(i * (i + 3) // 2)) for i in range(d)])


def rank(factor_: Column, d: int) -> Column:
    return F.size(F.filter(pivots(factor_, d), lambda x: x > 0))


def determinant(factor_: Column, d: int) -> Column:
    return F.aggregate(pivots(factor_, d), F.lit(1.0), lambda s, x: s * x * x)


def forward(factor_: Column, b: Column, d: int) -> Column:
    """z with L z = b; 0 for singular columns. b' A^-1 b is the sum of its squares."""

    def entry(done: Column, i: Column) -> Column:
        pivot = F.get(factor_, _row(i) + i)
        return F.concat(done, F.array(F.when(pivot > 0, (F.get(b, i) - dot(F.slice(factor_, _row(i) + 1, i), done)) / pivot).otherwise(0.0)))

    return F.aggregate(F.array(*map(F.lit, range(d))), _none(), entry)


def backward(factor_: Column, z: Column, d: int) -> Column:
    """x with L' x = z; 0 for singular columns."""
    after = lambda i: F.array(*map(F.lit, range(i + 1, d))) if i + 1 < d else _none("int")
    places = F.array(*[F.struct(F.lit(i).alias("i"), after(i).alias("after")) for i in reversed(range(d))])

    def entry(done: Column, p: Column) -> Column:  # the last entry is found first
        i, pivot = p["i"], F.get(factor_, _row(p["i"]) + p["i"])
        known = F.aggregate(p["after"], F.lit(0.0), lambda s, k: s + F.get(factor_, _row(k) + i) * F.get(done, F.lit(d - 1) - k))
        return F.concat(done, F.array(F.when(pivot > 0, (F.get(z, i) - known) / pivot).otherwise(0.0)))

    return F.reverse(F.aggregate(places, _none(), entry))


def solve(factor_: Column, b: Column, d: int) -> Column:
    """x with A x = b."""
    return backward(factor_, forward(factor_, b, d), d)
