"""Small closed-form expressions on columns: Hotelling's t² for one and two features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a, b)


def pooled(n0: Column, c0: Column, n1: Column, c1: Column) -> Column:
    """Population (co)variances of two groups, weighted by the groups' sizes."""
    return safe_div(n0 * c0 + n1 * c1, n0 + n1)


def t2_one(n0: Column, m0: Column, v0: Column, n1: Column, m1: Column, v1: Column) -> Column:
    """t² of one feature; null where the pooled variance is zero."""
    d = m1 - m0
    return safe_div(d * d, pooled(n0, v0, n1, v1)) * n0 * n1 / (n0 + n1)


def f_from_t2(t2: Column, n: Column, p: int) -> Column:
    """F of a t² over n observations of p features."""
    return safe_div(t2 * (n - p - 1), (n - 2) * p)


def log10_or_neg_inf(x: Column) -> Column:
    """log10(x); minus infinity for x <= 0 or null."""
    return F.when(x > 0, F.log10(x)).otherwise(F.lit(float("-inf")))
