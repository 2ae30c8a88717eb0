"""The greedy cut in rounds against the same cut one node after another."""

import random

import pytest

from regionframe.operators.antichain import around, greedy_cut, pointers
from regionframe.operators.tree import cover
from regionframe.sources.cut import Written


def trees():
    r = random.Random(2)
    out = {"chain": [*range(1, 40), None], "forest": [p if (p := i + 1 + r.randrange(5)) < 60 else None for i in range(60)], "roots": [None] * 4, "star": [9] * 9 + [None]}
    return {k: [(k, n, p, r.choice([None, float("nan"), 1.0, 2.5, round(r.random() * 9, 2), round(r.random() * 9, 2)])) for n, p in enumerate(v)] for k, v in out.items()}


@pytest.mark.parametrize("largest", [True, False])
def test_against_one_after_another(spark, largest):
    t = trees()
    df = spark.createDataFrame([r for v in t.values() for r in v], "name string, node int, parent int, value double")
    got = {(r.name, r.node) for r in greedy_cut(df, "value", ["name"], largest).collect()}
    worst = float("-inf") if largest else float("inf")
    want = set()
    for name, rows in t.items():
        known = {n for _, n, _, v in rows if v is not None and v == v}
        want |= {(name, n) for n in cover([(n, p, v if n in known else worst) for _, n, p, v in rows], largest) if n in known}
    assert got == want


def test_all_above_and_below_are_seen_along_few_pointers(spark):
    rows = [(0, n, n + 1 if n < 29 else None, (n * 7) % 30) for n in range(30)]
    df, w = spark.createDataFrame(rows, "perm int, node int, parent int, v int"), Written(spark, "test")
    ups = pointers(df, ["perm"], w)
    assert len(ups) == 5 and sum(u.count() for u in ups) == sum(30 - 2**n for n in range(5))
    got = {r.node: (r.above, r.below) for r in around(df, ups, ["perm"], w).collect()}
    assert got == {n: (min((v for _, m, _, v in rows if m > n), default=None), min((v for _, m, _, v in rows if m < n), default=None)) for n in range(30)}


def test_nothing(spark):
    assert greedy_cut(spark.createDataFrame([], "perm int, node int, parent int, v double"), "v").count() == 0
