"""Column algebra against numpy, singular cases included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionframe.functions import dense
from regionframe.operators.designs import group_moments, hotelling, products, regressed


@pytest.mark.parametrize("d", [1, 2, 5, 8])
def test_factor_determinant_solve(spark, d):
    r = np.random.default_rng(d)
    rows = []
    for _ in range(20):
        x = r.normal(size=(d + 3, d))
        rows.append(((x.T @ x).ravel().tolist(), r.normal(size=d).tolist()))
    a, b = F.col("a"), F.col("b")
    f = spark.createDataFrame(rows, "a array<double>, b array<double>").withColumn("l", dense.factor(a, d))
    got = f.select("a", "b", dense.determinant(F.col("l"), d).alias("det"), dense.solve(F.col("l"), b, d).alias("x"), dense.rank(F.col("l"), d).alias("rank"), dense.forward(F.col("l"), b, d).alias("z"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for x in got.collect():
        m, v = np.array(x.a).reshape(d, d), np.array(x.b)
        assert x.rank == d and np.isclose(x.det, np.linalg.det(m)) and np.allclose(x.x, np.linalg.solve(m, v)) and np.isclose(np.dot(x.z, x.z), v @ np.linalg.solve(m, v))


def test_dependent_columns_take_no_part(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(9, 2))
    x = np.column_stack([x[:, 0], 3 * x[:, 0], x[:, 1], x[:, 0] - x[:, 1], np.zeros(9)])
    v = x.T @ r.normal(size=9)
    l = dense.factor(F.col("a"), 5)  # noqa: E741
    got = spark.createDataFrame([((x.T @ x).ravel().tolist(), v.tolist())], "a array<double>, b array<double>").select(dense.rank(l, 5).alias("rank"), dense.determinant(l, 5).alias("det"), dense.solve(l, F.col("b"), 5).alias("x")).first()
    want = np.linalg.solve(x[:, [0, 2]].T @ x[:, [0, 2]], v[[0, 2]])
    assert got.rank == 2 and got.det == 0 and np.allclose(got.x, [want[0], 0, want[1], 0, 0])


def test_two_groups_of_four_features(spark):
    r, d = np.random.default_rng(3), 4
    rows = [(i % 3, i % 2, *r.normal(size=d).tolist()) for i in range(120)] + [(7, 1, *[1.0] * d), (8, 0, *[2.0] * d), (8, 1, *[3.0] * d)]
    names = [f"x{a}" for a in range(d)]
    got = {x.pos: x for x in hotelling(group_moments(spark.createDataFrame(rows, f"pos int, grp int, {', '.join(f'{n} double' for n in names)}"), ["pos"], names), d).collect()}
    for pos in range(3):
        a, b = (np.array([x[2:] for x in rows if x[0] == pos and x[1] == g]) for g in (0, 1))
        pooled = (len(a) * np.cov(a.T, bias=True) + len(b) * np.cov(b.T, bias=True)) / (len(a) + len(b))
        t2 = (b.mean(0) - a.mean(0)) @ np.linalg.inv(pooled) @ (b.mean(0) - a.mean(0)) * len(a) * len(b) / (len(a) + len(b))
        assert np.isclose(got[pos].t2, t2) and np.isclose(got[pos].det, np.linalg.det(pooled)) and np.isclose(got[pos].f, t2 * (len(a) + len(b) - d - 1) / ((len(a) + len(b) - 2) * d))
    assert got[7].t2 is None and got[8].t2 is None and got[8].rank == 0 and got[8].f is None  # an empty group; no variance


def test_regression_with_contrast_and_spatial_variance(spark):
    r, k = np.random.default_rng(4), 4
    x = np.column_stack([np.ones(60), r.normal(size=(60, k - 1))])
    y = x @ [1, 2, -1, 0.5] + r.normal(size=60)
    names = [f"c{i}" for i in range(k)]
    rows = [(1, float(v), *map(float, c)) for v, c in zip(y, x, strict=True)] + [(2, 5.0, 1.0, float(i), float(2 * i), 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, f"key int, y double, {', '.join(f'{n} double' for n in names)}")
    got = {g.key: g for g in regressed(products(df, ["key"], names), [True, True, True, False], F.lit(0.25), F.lit(3)).collect()}
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    rest = y - x[:, 3] * beta[3]
    r2 = 1 - (((y - x @ beta) ** 2).mean() + 0.25) / (rest.var() + 0.25)
    assert np.allclose(got[1].beta, beta) and np.isclose(got[1].r2, r2) and np.isclose(got[1].f, r2 / (1 - r2) * (180 - k) / (k - 1))
    assert np.isclose(got[2].beta[0], 5) and np.isclose(got[2].beta[3], 0) and np.isclose(got[2].r2, 0)  # the last column is the bias again
    assert regressed(products(df.limit(0), ["key"], names), [True] * 4).count() == 0
