"""Merge trees in shared rounds against the same rule in plain Python, on kernels' costs."""

import itertools

import numpy as np

from regionframe.jobs.rounds import regress_sums, regression_leaves, subject_blocks
from regionframe.operators.agglomerate import Regression, TwoGroups, six_neighbours
from regionframe.operators.rounds import merge_trees, two_groups

POINTS = list(itertools.product(range(3), range(3), range(2)))


def mutual_best(moments, edges, objective):
    """{leaves of a node: (leaves of its parent, cost)} of all nodes."""
    regions, near = {frozenset([n]): m for n, m in enumerate(moments)}, {frozenset([frozenset([a]), frozenset([b])]) for a, b in edges}
    numbers, out, count = {r: min(r) for r in regions}, {}, 0
    base = len(moments)
    while near:
        count += 1
        cost = {}
        for e in near:
            a, b = sorted(e, key=numbers.get)
            cost[e] = (round(objective.cost(regions[a], regions[b], len(a), len(b)), 12), numbers[a], numbers[b])
        best = {r: min((cost[e], sorted(map(sorted, e))) for e in near if r in e)[1] for e in near for r in e}
        pairs = [e for e in near if all(best[r] == sorted(map(sorted, e)) for r in e)]
        for e in pairs:
            a, b = e
            both = a | b
            out[a] = out[b] = (both, cost[e][0])
            numbers[both] = count * base + min(both)
            regions[both] = regions.pop(a) + regions.pop(b)
        moved = {r: out[r][0] for e in pairs for r in e}
        near = {frozenset(moved.get(r, r) for r in e) for e in near}
        near = {e for e in near if len(e) == 2}
    return out


def as_sets(rows):
    """The same of rows (node, parent, cost)."""
    children = {}
    for r in rows:
        children.setdefault(r.parent, []).append(r.node)
    leaves = lambda n: frozenset().union(*map(leaves, children[n])) if n in children else frozenset([n])
    cost = {r.node: r.cost for r in rows}
    return {leaves(r.node): (leaves(r.parent), cost[r.parent]) for r in rows if r.parent is not None}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1], atol=1e-9) for k in want)


def test_two_groups_of_two_permutations(spark):
    r, columns = np.random.default_rng(1), TwoGroups.columns
    edges, rows, want = six_neighbours(POINTS), [], []
    for perm in (0, 1, 2):
        x, grp = r.normal(size=(20, len(POINTS))), r.permutation([0] * 9 + [1] * 11)
        m = np.array([[v for g in (0, 1) for v in ((grp == g).sum(), x[grp == g, n].sum(), (x[grp == g, n] ** 2).sum())] for n in range(len(POINTS))], float)
        rows += [(perm, n, *map(float, v)) for n, v in enumerate(m)]
        want.append(mutual_best(m, edges, TwoGroups()))
    leaves = spark.createDataFrame(rows, f"perm int, node int, {', '.join(f'{c} double' for c in columns)}")
    got = merge_trees(leaves, spark.createDataFrame(edges, "src int, dst int"), two_groups()).collect()
    for perm in (0, 1, 2):
        mine = [x for x in got if x.perm == perm]
        same(as_sets(mine), want[perm])
        root = [x for x in mine if x.parent is None]
        m = np.array([x[2:] for x in rows if x[0] == perm]).sum(0)
        assert len(root) == 1 and root[0].size == len(POINTS) and np.isclose(root[0].stat, TwoGroups().stat(m, len(POINTS))[0])
        assert all(x.round == 0 if x.node < len(POINTS) else x.round >= 1 for x in mine) and all(x.parent is None or x.parent > x.node for x in mine)


def test_regression_with_nuisance(spark):
    r, n = np.random.default_rng(2), 40
    y, z, x = r.normal(size=(n, len(POINTS))), r.normal(size=n), r.normal(size=n)
    y[:, :6] += x[:, None]
    edges, want, designs = six_neighbours(POINTS), {}, []
    for perm in (0,):
        xs = r.permutation(x)
        designs += [(perm, 3 * s, 1.0, float(xs[s]), float(z[s])) for s in range(n)]
        objective = Regression(np.column_stack([np.ones(n), xs, z]), np.array([False, False, True]))
        want[perm] = mutual_best(np.concatenate([y, y**2]).T, edges, objective), objective
    images = spark.createDataFrame([(3 * s, v, float(y[s, v])) for s in range(n) for v in range(len(POINTS))], "sbj long, node int, y double")
    d = spark.createDataFrame(designs, "perm int, sbj long, one double, x double, z double")
    names = ["one", "x", "z"]
    trees = merge_trees(regression_leaves(images, d, names), spark.createDataFrame(edges, "src int, dst int"), regress_sums(d, names, [True, True, False]), subject_blocks(images)).collect()
    for perm, (tree, objective) in want.items():
        mine = [t for t in trees if t.perm == perm]
        same(as_sets(mine), tree)
        root = next(t for t in mine if t.parent is None)
        stat, f = objective.stat(np.concatenate([y.sum(1), (y**2).sum(1)]), len(POINTS))
        assert np.isclose(root.stat, stat) and np.isclose(root.f, f)


def test_forest_and_nothing(spark):
    leaves = spark.createDataFrame([(0, n, 2.0, float(n), float(n * n + 1), 2.0, 1.0, 4.0) for n in range(4)], "perm int, node int, n0 double, s0 double, q0 double, n1 double, s1 double, q1 double")
    got = merge_trees(leaves, spark.createDataFrame([(0, 1), (1, 0), (2, 2)], "src int, dst int"), two_groups())
    assert sorted((x.node, x.parent, x.size, x.round) for x in got.collect()) == [(0, 4, 1, 0), (1, 4, 1, 0), (2, None, 1, 0), (3, None, 1, 0), (4, None, 2, 1)]
    assert merge_trees(leaves.limit(0), spark.createDataFrame([(0, 1)], "src int, dst int"), two_groups()).count() == 0
