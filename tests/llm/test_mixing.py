import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionframe.llm import mixing
from regionframe.llm.mixing import fit, mix, mixed_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, times string"


def brute_targets(sizes):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in fixed}
        left = total - sum(fixed.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def docs(spark, n=400, seed=1):
    r, rows = random.Random(seed), []
    for i in range(n):
        source = r.choice(["a", "a", "a", "a", "b", "c", "d", None, "Z"])
        rows.append((i, r.choice([None, "", "x y z", " ".join(["w"] * r.randint(1, 60)), "tab\tand nbsp \u000b v"]), "en", source, 0, 99, "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_and_sizes(spark):
    d = docs(spark)
    got = mix(d).collect()
    size = {}
    for r in d.collect():
        import re

        size[r.doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert {r.doc_id: r.size for r in got} == size
    sums = {}
    for r in d.collect():
        sums[r.source] = sums.get(r.source, 0) + size[r.doc_id]
    want = brute_targets(sums)
    for s, t in want.items():
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sums[s] and abs(r.target - t) < 1e-6 * max(1, t) and 0 <= r.epochs <= 3 for r in mine)
        assert abs(sum(r.epochs * r.size for r in mine) - t) <= 1


def test_reruns_agree(spark):
    d = docs(spark).where("source is not null")
    assert sorted(map(tuple, mix(d).collect())) == sorted(map(tuple, mix(d.repartition(5)).collect()))


@pytest.mark.parametrize("reserve", [1, 8, 1 << 16])
def test_fit_is_closest(monkeypatch, reserve):
    """However much of the budget is dealt in proportion first."""
    monkeypatch.setattr(mixing, "RESERVE", reserve)
    r = random.Random(3)
    for _ in range(60):
        lengths = np.array(sorted(r.sample(range(1, 40), r.randint(1, 6))), np.int64)
        counts = np.array([r.randint(1, 4) for _ in lengths], np.int64)
        budget = r.randint(0, int((lengths * counts).sum()))
        take = fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_fit_of_large_budgets():
    big = np.arange(1, 3000, dtype=np.int64)
    for budget in (65_535, 65_536, 65_537, 100_000_003):
        assert int((fit(big, np.full(len(big), 50), budget) * big).sum()) == budget
    even = np.array([2, 40, 90_000])
    assert int((fit(even, np.array([9, 9, 9]), 450_005) * even).sum()) in (450_004, 450_006)
    assert fit(np.array([100_000]), np.array([9]), 449_999).tolist() == [4]
    assert fit(np.array([70_000, 100_003]), np.array([2, 2]), 240_000).tolist() == [2, 1]


def test_memory_follows_the_longest_length_not_the_budget():
    import tracemalloc

    n = 10**9
    tracemalloc.start()
    for budget in (3 * n + n // 2, 3 * n + 1, 7 * n + 5, 7 * n + 10):
        take = fit(np.array([7, 11]), np.array([n, 1]), budget)
        total = int(take[0]) * 7 + int(take[1]) * 11
        best = min(abs(s - budget) for m in (0, 11) for k in (min(n, (budget - m) // 7), min(n, (budget - m) // 7 + 1)) for s in (7 * k + m,))
        assert abs(total - budget) == best and take[0] <= n and take[1] <= 1
    # no sum is next to the budget: the search goes to its last distance
    take = fit(np.array([1500, 1501]), np.array([n, 2]), 1500 * 10**8 + 700)
    assert abs(int(take @ np.array([1500, 1501])) - (1500 * 10**8 + 700)) == 698
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


@pytest.mark.parametrize("reserve", [1, 64])
def test_fit_of_few_sums_is_closest(monkeypatch, reserve):
    """Long lengths, few of them: hardly any sum is next to a budget."""
    monkeypatch.setattr(mixing, "RESERVE", reserve)
    r = random.Random(5)
    for _ in range(80):
        lengths = np.array(sorted(r.sample(range(20, 60), r.randint(1, 3))), np.int64)
        counts = np.array([r.choice([1, 2, 30]) for _ in lengths], np.int64)
        budget = r.randint(0, int((lengths * counts).sum()))
        take, sums = fit(lengths, counts, budget), {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((take * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_empty_and_repeated(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    d = spark.createDataFrame([(1, "a b c", "en", "s", 5, 0, ""), (1, "a b c", "en", "s", 5, 0, ""), (None, None, None, None, None, None, None)], SCHEMA)
    assert sorted((r.size, r.epochs) for r in mix(d).collect() if r.doc_id) == [(3, 1), (3, 1)]
    assert mixed_documents(d).columns == d.columns


def test_repeated_rows_each_have_their_lot(spark, monkeypatch):
    """Ten rows of one document, rows of one doc_id with other texts, null ids: the mix takes what the targets say."""
    text = lambda n: " ".join(["w"] * n)
    rows = [(1, text(7), "en", "a", 5, 0, "")] * 10 + [(1, text(n), "en", "a", 5, 0, "") for n in range(1, 12)] + [(None, text(n), "en", "b", 5, 0, "") for n in range(1, 9)] + [(None, text(4), "en", "b", 5, 0, "")] * 30
    rows += [(i, text(1 + i % 5), "en", "c", 5, 0, "") for i in range(2, 90)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = mix(d).collect()
    assert sorted((r.doc_id or 0, r.source, r.size) for r in got) == sorted((r[0] or 0, r[3], len(r[1].split())) for r in rows)
    for s in "abc":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.epochs * r.size for r in mine) - mine[0].target) <= 1 and {r.epochs for r in mine} <= {0, 1, 2, 3}
        assert max(r.epochs for r in mine) - min(r.epochs for r in mine) <= 1
    taken = mixed_documents(d).collect()
    for s in "abc":
        assert sum(len(r.text.split()) for r in taken if r.source == s) == sum(r.epochs * r.size for r in got if r.source == s)
    again = spark.range(3).select("id", F.lit(25_000).cast("long").alias("n"))
    whole = mixing.repeated(again, F.col("n") + F.col("id"), "nth")
    assert sorted((r.id, r.n) for r in whole.groupBy("id").agg(F.countDistinct("nth").alias("n")).collect()) == [(0, 25_000), (1, 25_001), (2, 25_002)]


def test_the_choice_does_not_depend_on_the_number_of_slices(spark, monkeypatch):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 300, "a").otherwise("b").alias("source"))
    few = {r.doc_id for r in mix(d).collect() if r.epochs}
    monkeypatch.setattr(mixing.math, "isqrt", lambda n: 1 << 12)
    assert few == {r.doc_id for r in mix(d).collect() if r.epochs}
