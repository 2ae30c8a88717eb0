import random

import numpy as np
import pytest

from regionframe.llm import forest as module
from regionframe.llm.forest import Forest, nearest, usable

SCHEMA = "vec_id long, embedding array<float>, v string, id int, tree string, leaf string, rank int"


def product(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=False):
        total += x * y
    return total


def brute(rows, every, k):
    one = {}
    for i, e, *_ in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e):
            x = [float(a) for a in np.array(e, np.float32)]
            one[i] = min(one.get(i, x), x)
    out = []
    for q in sorted(i for i in one if i % every == 0):
        best = sorted((-product(one[q], v), i) for i, v in one.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def rows(n, dims, seed=4, groups=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dims)) + (r.normal(size=(groups, dims))[r.integers(0, groups, n)] * 4 if groups else 0)
    return [(i, [float(a) for a in v], "c", 1, "t", "l", 2) for i, v in enumerate(x.astype(np.float32))]


def odd(n):
    r, blank = random.Random(1), ("c", 1, "t", "l", 2)
    d = rows(n, 6)
    d += [(n + i, d[3][1], *blank) for i in range(n // 2)]  # a hot vector
    d += [(2 * n + i, [float(r.randint(-2, 2)) for _ in range(6)], *blank) for i in range(60)]  # ties
    nan, inf = float("nan"), float("inf")
    d += [(3000 + i, e, *blank) for i, e in enumerate([None, [], [0.0] * 6, [1.0, None], [nan] * 6, [inf, 1.0], [2.0], [-0.0, 0.0, 5.0], [1e30] * 6, [1e-30] * 6])]
    return d + [(None, [1.0] * 6, *blank), d[5], d[10], (20, [-9.0] * 6, *blank), (25, [9.0] * 6, *blank)]


@pytest.mark.parametrize("cell", [8192, 40])
def test_all_found_where_all_is_wanted(spark, monkeypatch, cell):
    monkeypatch.setattr(module, "CELL", cell)
    monkeypatch.setattr(module, "PART_QUERIES", cell)
    d = odd(300)
    v = usable(spark.createDataFrame(d, SCHEMA).repartition(4))
    got = nearest(v, v.where("vec_id % 5 = 0"), k=7, trees=3, leaf_rows=8, recall=1.0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute(d, 5, 7)


@pytest.mark.parametrize("groups", [0, 40])
def test_recall(spark, groups):
    d = rows(4000, 16, groups=groups)
    v = usable(spark.createDataFrame(d, SCHEMA).repartition(4))
    got = nearest(v, v.where("vec_id % 20 = 0"), leaf_rows=32).collect()
    want = brute(d, 20, 20)
    found = {(r.query_id, r.vec_id): r.score for r in got}
    assert len(got) == len(want) == len(found)
    assert sum((q, i) in found for q, _, i, _ in want) >= 0.9 * len(want)
    x = {i: np.array(e) for i, e, *_ in d}
    assert all(abs(s - x[q] @ x[i]) < 1e-9 for (q, i), s in found.items())


def test_too_few_candidates_are_made_up_for(spark, monkeypatch):
    monkeypatch.setattr(module, "wanted_leaves", lambda *a: 1)
    d = rows(200, 5)
    v = usable(spark.createDataFrame(d, SCHEMA))
    got = nearest(v, v.where("vec_id % 20 = 0"), k=20, leaf_rows=8).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute(d, 20, 20)


def test_few_and_none(spark):
    v = usable(spark.createDataFrame([(0, [1.0, 2.0], *[None] * 5), (1, [3.0, 1.0], *[None] * 5)], SCHEMA))
    assert [tuple(r) for r in nearest(v, v.where("vec_id = 0")).collect()] == [(0, 1, 1, 5.0)]
    assert nearest(v, v.where("false")).count() == 0 and nearest(v.where("false"), v).count() == 0
    assert nearest(v.where("vec_id = 0"), v.where("vec_id = 0")).count() == 0


def test_the_queue_gives_the_leaves_of_least_priority():
    r = np.random.default_rng(2)
    v, q = r.normal(size=(600, 5)), r.normal(size=(9, 5))
    turns = np.stack([np.linalg.qr(r.normal(size=(6, 6)))[0][:, :5] for _ in range(3)])
    f = Forest(5, float(np.abs(v).max()), float(np.sqrt(((v / np.abs(v).max()) ** 2).sum(1).max())), 5, turns).fit(v)
    whole = np.sort(f.queue(q, 96)[0], 1)
    for most in (1, 7, 40):
        assert np.allclose(np.sort(f.queue(q, most)[0], 1), whole[:, :most])
    cost, tree, leaf = f.queue(q, 96)
    own, stored, asked = f.leaves(v), f.stored(v), f.asked(q)
    for n in range(len(q)):  # a leaf's priority is no more than the squared distance of any of its vectors
        for c, t, at in zip(cost[n], tree[n], leaf[n], strict=True):
            members = stored[own[:, t] == at]
            assert not len(members) or ((members - asked[n]) ** 2).sum(1).min() >= c - 1e-9
