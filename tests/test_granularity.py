"""Labels at chosen numbers of regions against a replay of the merges."""

import random

from regionframe.operators.granularity import labels_at, spaced


def test_spacing():
    assert spaced(64, 5) == [1, 3, 8, 23, 64] and spaced(1, 5) == [1] and spaced(0, 5) == [] and spaced(9, 1) == [1]
    assert spaced(1000, 4, 10) == [10, 46, 215, 1000]


def test_labels_against_replayed_merges(spark):
    r, voxels = random.Random(2), 60
    live, parent = list(range(voxels)), {}
    for n in range(voxels, voxels + 55):  # a forest: five roots stay
        a, b = r.sample(live, 2) if n % 3 else (live[-1], live[0])
        parent[a] = parent[b] = n
        live = [x for x in live if x not in (a, b)] + [n]
    rows = [(n, parent.get(n), "clash") for n in range(voxels + 55)]
    regions = [2, 5, 6, 17, 59, 60, 99]
    got = {(x.t, x.leaf): x.label for x in labels_at(spark.createDataFrame(rows, "node long, parent long, label string"), regions, voxels).collect()}
    want = {}
    for t, n in enumerate(regions):
        done = min(55, max(0, voxels - n))
        for leaf in range(voxels):
            at = leaf
            while (up := parent.get(at)) is not None and up < voxels + done:
                at = up
            want[t, leaf] = at + 1
    assert got == want and len({v for (t, _), v in got.items() if t == 3}) == 17


def test_empty(spark):
    assert labels_at(spark.createDataFrame([], "node long, parent long"), [1, 2], 0).count() == 0
