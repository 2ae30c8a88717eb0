import numpy as np
from pyspark.sql import functions as F

from regionframe.jobs.inference import regression_trees
from regionframe.jobs.regress import permutation_map
from regionframe.operators.agglomerate import Regression, agglomerate, six_neighbours


def test_regression_trees_of_many_subjects_take_each_as_a_row(spark, tmp_path):
    r, n = np.random.default_rng(4), 2_100
    x, y = r.integers(0, 10, n), r.normal(0, 1, (n, 64))
    y[:, :12] += 0.2 * x[:, None]
    rows = [(i, y[i].tolist(), int(x[i])) for i in range(n)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    edges, design = six_neighbours([(v // 16, v // 4 % 4, v % 4) for v in range(64)]), np.column_stack([np.ones(n), x])
    got = regression_trees(spark, d, 1).toPandas().sort_values(["perm", "node"])
    moved = permutation_map(spark.range(n).select(F.col("id").alias("sbj")), 1).toPandas().sort_values("sbj")["taken"].to_numpy()
    for perm, move in ((0, None), (1, moved)):
        want = agglomerate(np.concatenate([y.T, y.T**2], 1), edges, Regression(design, None, move))
        g = got[got["perm"] == perm]
        assert [None if p is None or p != p else int(p) for p in g["parent"].astype(object)] == [w[1] for w in want] and g["size"].tolist() == [w[2] for w in want]
        assert np.allclose(g[["stat", "f", "cost"]].to_numpy(float), np.array([w[3:] for w in want], float), rtol=1e-7, atol=1e-9, equal_nan=True)
