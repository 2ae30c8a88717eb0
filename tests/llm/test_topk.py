import math
import random

import numpy as np

from regionframe.llm import topk
from regionframe.llm.topk import accumulate, quantised, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, v string, block int, rank string"


def test_accumulation_is_the_inner_product():
    r = np.random.default_rng(1)
    for share in (0.1, 0.9):
        q, c = (r.integers(-50, 50, (n, 9)) * (r.random((n, 9)) < share) for n in (5, 40))
        assert (accumulate(q, c) == q @ c.T).all()


def brute(rows, every, k):
    v = [(i, [math.floor(256 * x) for x in np.array(e, np.float32).astype(float)]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q in sorted({i for i, _ in v if i % every == 0}):
        a = min(x for i, x in v if i == q)
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in v if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 7)
    r = random.Random(2)
    rows = [(i, [r.choice([0.0, r.gauss(0, 0.2)]) for _ in range(6)], 1, "x", 2, "y") for i in range(60)]
    rows += [(60 + i, rows[3][1], 1, "x", 2, "y") for i in range(12)]  # ties
    rows += [(100, None, 1, None, None, None), (101, [1.0, None], 1, None, None, None), (102, [float("nan")] * 6, 1, None, None, None), (105, [float("inf")] * 6, 1, None, None, None)]
    rows += [(110, [0.5], 1, None, None, None), (115, [], 1, None, None, None), (None, [1.0] * 6, 1, None, None, None), rows[5], (10, [0.1] * 6, 1, None, None, None)]
    v = quantised(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = top_k(v, v.where("vec_id % 5 = 0"), 5, 4).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 5)


def test_few_and_none(spark):
    d = quantised(spark.createDataFrame([(0, [1.0], 0, None, None, None), (1, [1.0], 0, None, None, None)], SCHEMA))
    assert [tuple(r) for r in top_k(d, d.where("vec_id = 0")).collect()] == [(0, 1, 1, 65536)]
    assert top_k(d, d.where("false")).count() == 0 and top_k(d.where("vec_id = 0"), d.where("vec_id = 0")).count() == 0


def test_selection_of_large_scores_and_ties():
    r = np.random.default_rng(3)
    for top in (3, 2**62):
        scores = r.integers(-top, top, (40, 300))
        for keep in (1, 7, 299, 300, 400):
            rows, cols = topk.best_of(scores, keep)
            want = [(n, int(c)) for n, row in enumerate(scores) for c in np.lexsort((np.arange(300), [-int(x) for x in row]))[:keep]]
            assert sorted(zip(rows.tolist(), cols.tolist(), strict=True)) == sorted(want)


def test_components_of_fifty_thousand_and_whole_blocks(spark):
    """Scores near 10^16 in blocks of 4096, and very long vectors."""
    rows = [(i, [46875.0] * 8 if i % 1000 == 0 else [100.0 * (i % 2500) + (i % 3)] * 8, 1, None, None, None) for i in range(5000)]
    v = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = sorted(map(tuple, top_k(quantised(v), quantised(v).where("vec_id % 500 = 0")).collect()))
    assert got == brute(rows, 500, 5) and max(s for *_, s in got) > 2.25e15
    long = [(i, [float(i + d % 5) for d in range(20_000)], 1, None, None, None) for i in range(4)]
    v = quantised(spark.createDataFrame(long, SCHEMA))
    assert sorted(map(tuple, top_k(v, v.where("vec_id = 2"), 3).collect())) == brute(long, 2, 3)[-3:]
