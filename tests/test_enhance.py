"""Enhancement in blocks against the kernel that holds the whole image."""

import math

import numpy as np
import pytest

from regionframe.operators.clusters import tfce
from regionframe.operators.enhance import enhanced

SCHEMA = "perm int, i int, j int, k int, r2 double, level string, size string"


def images(seed):
    r, rows = np.random.default_rng(seed), []
    for perm in range(3):
        for p in np.ndindex(7, 5, 6):
            if r.random() < 0.9:
                v = float(max(0.0, r.normal() + 2 * math.sin(p[0] + perm) * math.cos(p[2]))) if perm else float(-r.random())
                rows.append((perm, p[0] - 3, p[1], p[2], [v, None, math.nan][r.choice(3, p=[0.94, 0.03, 0.03])], "clash", None))
    return rows


@pytest.mark.parametrize("edge", [1, 3, 64])
def test_blocks_equal_the_whole_image(spark, edge):
    rows = images(4)
    got = {(r.perm, r.i, r.j, r.k): r.tfce for r in enhanced(spark.createDataFrame(rows, SCHEMA), "r2", edge).collect()}
    assert len(got) == len(rows)
    for perm in range(3):
        mine = [r for r in rows if r[0] == perm]
        want = tfce([r[1:4] for r in mine], np.array([math.nan if r[4] is None else r[4] for r in mine]))
        assert (want > 0).any() == (perm > 0)
        for r, w in zip(mine, want, strict=True):
            assert got[r[:4]] == pytest.approx(w, rel=1e-12)


def test_a_winding_path_is_one_component(spark):
    """A snake through all blocks of two voxels' side: one component at every level."""
    path = [(i if j % 4 == 0 else 8 if j % 4 == 1 else 8 - i if j % 4 == 2 else 0, j, 0) for j in range(9) for i in (range(9) if j % 2 == 0 else [0])]
    rows = [(0, *p, 1.0, "", "") for p in dict.fromkeys(path)]
    got = {r.tfce for r in enhanced(spark.createDataFrame(rows, SCHEMA), "r2", 2).collect()}
    want = tfce([r[1:4] for r in rows], np.ones(len(rows)))
    assert len(set(want)) == len(got) == 1 and got.pop() == pytest.approx(want[0])


def test_empty(spark):
    assert enhanced(spark.createDataFrame([], SCHEMA), "r2").count() == 0
    flat = spark.createDataFrame([(0, 0, 0, 0, None, "", ""), (0, 1, 0, 0, -1.0, "", "")], SCHEMA)
    assert [r.tfce for r in enhanced(flat, "r2").collect()] == [0, 0]
