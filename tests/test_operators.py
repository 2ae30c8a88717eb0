import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionframe.jobs.inference import inference
from regionframe.operators import grid as G
from regionframe.operators import moments as M
from regionframe.operators.agglomerate import Regression, TwoGroups, agglomerate, trees
from regionframe.operators.clusters import grown_mask, min_variance_mask, tfce
from regionframe.operators.components import connected
from regionframe.operators.tree import ancestors, closure, cover
from regionframe.sources.volumes import cube_of, decode_nifti, decode_tracks, encode_nifti, read_volumes
from regionframe.streaming.moments import run_available

SHAPE = (3, 3, 2)
POINTS = [(i, j, k) for i in range(3) for j in range(3) for k in range(2)]
EDGES = sorted({(a, b) for a, p in enumerate(POINTS) for b, q in enumerate(POINTS) if a < b and sum(abs(x - y) for x, y in zip(p, q, strict=True)) == 1})


def moments(seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(len(POINTS), 2, 7))
    return np.concatenate([np.stack([np.full(len(POINTS), 7.0), x[:, g].sum(1), (x[:, g] ** 2).sum(1)], 1) for g in (0, 1)], 1)


def brute(m, edges, objective):
    """Merge the cheapest of all edges, recomputed each time."""
    stats, size, near, out = dict(enumerate(m)), dict.fromkeys(range(len(m)), 1), set(edges), []
    while near:
        c, a, b = min((objective.cost(stats[a], stats[b], size[a], size[b]), a, b) for a, b in near)
        new = len(m) + len(out)
        out.append((a, b, new))
        stats[new], size[new] = stats.pop(a) + stats.pop(b), size.pop(a) + size.pop(b)
        near = {(min(x, y), max(x, y)) for x, y in ((new if x in (a, b) else x, new if y in (a, b) else y) for x, y in near) if x != y}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_agglomeration_against_brute_force(seed):
    m = moments(seed)
    rows = agglomerate(m, EDGES, TwoGroups())
    assert len(rows) == 2 * len(POINTS) - 1
    children = {}
    for node, parent, *_ in rows:
        children.setdefault(parent, []).append(node)
    assert [(*sorted(children[n]), n) for n in range(len(POINTS), len(rows))] == [(*sorted((a, b)), n) for a, b, n in brute(m, EDGES, TwoGroups())]
    assert all(sum(rows[c][2] for c in children[n]) == rows[n][2] for n in range(len(POINTS), len(rows)))


def test_agglomeration_options():
    m = moments(9)
    assert sum(p is None for _, p, *_ in agglomerate(m, EDGES, TwoGroups(), stop=4)) == 4
    assert max(r[2] for r in agglomerate(m, EDGES, TwoGroups(), largest=3)) <= 4
    batched = agglomerate(m, EDGES, TwoGroups(), share=0.3)
    assert batched[-1][2] == len(POINTS) and len(batched) <= 2 * len(POINTS) - 1
    two = [e for e in EDGES if all(POINTS[x][0] != 1 for x in e)]
    assert sum(p is None for _, p, *_ in agglomerate(m, two, TwoGroups())) == 2 + 6
    x = np.column_stack([np.ones(7), np.arange(7.0)])
    y = np.random.default_rng(1).normal(size=(len(POINTS), 7))
    r = agglomerate(np.concatenate([y, y**2], 1), EDGES, Regression(x))
    beta = np.linalg.lstsq(x, y[0], rcond=None)[0]
    assert r[0][3] == pytest.approx(1 - ((y[0] - x @ beta) ** 2).mean() / y[0].var()) and r[-1][2] == len(POINTS)


def test_planted_effect_is_found(spark):
    r = np.random.default_rng(3)
    truth = {v for v in range(64) if v // 16 < 2 and v // 4 % 4 < 2 and v % 4 < 2}
    x = r.normal(size=(64, 40))
    label = np.arange(40) % 2
    for v in truth:
        x[v, label == 1] += 2.0
    rows = []
    for perm in range(25):
        g = label if perm == 0 else r.permutation(label)
        for v in range(64):
            a, b = x[v, g == 0], x[v, g == 1]
            rows.append((perm, v, v // 16, v // 4 % 4, v % 4, float(len(a)), float(a.sum()), float((a**2).sum()), float(len(b)), float(b.sum()), float((b**2).sum())))
    leaves = spark.createDataFrame(rows, "perm int, node int, i int, j int, k int, n0 double, s0 double, q0 double, n1 double, s1 double, q1 double")
    t = trees(leaves)
    got = inference(t, 0.05).where("significant").select("node").collect()
    below = {}
    for c in closure(t.where("perm = 0").select("node", "parent")).collect():
        below.setdefault(c.ancestor, set()).add(c.leaf)
    found = set().union(*[below[x.node] for x in got]) if got else set()
    assert len(found & truth) / len(truth) > 0.9 and len(found - truth) <= 8


def test_cover_is_an_antichain():
    r = random.Random(2)
    for _ in range(30):
        n = r.randint(1, 25)
        parent = {i: r.randint(i + 1, n - 1) if i < n - 1 else None for i in range(n)}
        nodes = [(i, parent[i], r.random()) for i in range(n)]

        def up(i, parent=parent):
            out = set()
            while parent[i] is not None:
                i = parent[i]
                out.add(i)
            return out

        want, gone = [], set()
        for i, _, _ in sorted(nodes, key=lambda x: -x[2]):
            if i not in gone:
                want.append(i)
                gone |= {i} | up(i) | {j for j in range(n) if i in up(j)}
        assert cover(nodes) == want


def test_closure_of_a_chain_and_a_forest(spark):
    t = spark.createDataFrame([(i, i + 1 if i < 40 else None) for i in range(41)] + [(100, 101), (101, None)], "node int, parent int")
    assert ancestors(t).count() == 40 * 41 // 2 + 1 and {r.ancestor for r in closure(t).where("leaf = 0").collect()} == set(range(41))


def test_components_of_a_path(spark):
    n = spark.range(60).withColumnRenamed("id", "node")
    e = spark.range(58).where("id <> 30").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = {r.node: r.label for r in connected(n, e).collect()}
    assert got == {i: 0 if i <= 30 else 31 if i <= 58 else 59 for i in range(60)}


def test_moments_golden(spark):
    d = spark.range(25).select(F.when(F.col("id") < 10, F.col("id")).otherwise(F.col("id") - 10).cast("double").alias("x"), (F.col("id") < 10).alias("g"))
    s = d.groupBy("g").agg(*M.additive([F.col("x")]))
    r = M.derived(M.merge(s, [], 1), [], 1).first()
    assert (r.n, r.mu0, r.cov00) == (25, 6.0, 16.0)
    with pytest.raises(Exception, match="more observations"):
        M.unmerge(s.where("g"), s.where("g"), ["g"], 1).collect()


def test_dilation_golden(spark):
    eye = spark.createDataFrame([(i, i, 0) for i in range(4)], "i int, j int, k int")
    got = {(r.i, r.j) for r in G.dilate(eye, 1, (4, 4, 1)).collect()}
    assert got == {(i, j) for i in range(4) for j in range(4) if abs(i - j) <= 1}
    assert G.erode(eye).count() == 0


def test_tfce_against_direct_sum():
    r = np.random.default_rng(5)
    v = np.round(np.abs(r.normal(size=len(POINTS))), 2)
    got, top = tfce(POINTS, v, steps=20), v.max()
    want = np.zeros(len(POINTS))
    for k in range(1, 21):
        h = top * k / 20
        on = {i for i in range(len(POINTS)) if v[i] >= h - 1e-12}
        for i in on:
            comp, todo = {i}, [i]
            while todo:
                a = todo.pop()
                for e in EDGES:
                    if a in e and (b := e[0] + e[1] - a) in on and b not in comp:
                        comp.add(b)
                        todo.append(b)
            want[i] += len(comp) ** 0.5 * h**2 * top / 20
    assert got == pytest.approx(want) and tfce(POINTS, -v).sum() == 0


def test_masks_are_connected_and_of_the_size():
    m = np.column_stack([np.full(len(POINTS), 4.0), np.arange(len(POINTS)), np.arange(len(POINTS)) ** 2 + 1.0])
    for got in (grown_mask(POINTS, 3, 7, np.arange(len(POINTS))), min_variance_mask(POINTS, m, 3, 7)):
        seen, todo = {3}, [3]
        while todo:
            a = todo.pop()
            for e in EDGES:
                if a in e and (b := e[0] + e[1] - a) in got and b not in seen:
                    seen.add(b)
                    todo.append(b)
        assert len(got) == 7 and seen == set(got)


def test_volumes(spark, tmp_path):
    r, rows = np.random.default_rng(1), []
    vols = {}
    for s in ("a", "b"):
        for f in ("A", "B"):
            v = r.normal(size=(2, 3, 4))
            v[0, 0, 0] = 0
            vols[s, f] = v
            p = tmp_path / f"{f}_{s}.nii.gz"
            p.write_bytes(encode_nifti(v, np.diag([2, 3, 4, 1.0])))
            rows.append((s, f, f"file:{p}"))
    got, affine = decode_nifti((tmp_path / "A_a.nii.gz").read_bytes())
    assert (got == vols["a", "A"]).all() and (affine == np.diag([2, 3, 4, 1])).all()
    assert decode_nifti(encode_nifti(got > 0))[0].sum() == (got > 0).sum()
    cube = cube_of(read_volumes(spark, spark.createDataFrame(rows, "sbj string, feat string, path string"), [str(tmp_path)]), ["A", "B"]).collect()
    assert len(cube) == 2 * 23 and all(x.x == [vols[x.sbj, f][x.i, x.j, x.k] for f in "AB"] for x in cube)


def test_tracks():
    head = bytearray(1000)
    lines = [np.arange(6, dtype="<f4").reshape(2, 3), np.ones((1, 3), "<f4")]
    data = bytes(head) + b"".join(struct.pack("<i", len(x)) + x.tobytes() for x in lines)
    assert decode_tracks(data).tolist() == [[0, 1, 2], [3, 4, 5], [1, 1, 1]] and len(decode_tracks(bytes(head))) == 0


def test_streamed_moments_are_the_batch_s(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    run_available(spark, src, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.hour, r.event_type): (r.n, round(r.s, 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    e = spark.read.parquet(src)
    want = {(r.h, r.event_type): (r.n, round(r.s, 6)) for r in e.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").agg(F.count("value").alias("n"), F.sum("value").alias("s")).collect()}
    last = max(k[0] for k in want)
    assert got and all(want[k] == v for k, v in got.items()) and all(k in got or (last - k[0]).total_seconds() <= 3 * 3600 for k in want)


def test_trees_of_two_features_against_brute_force():
    """Greedy merges by determinants recomputed from the values themselves; ties and a forest."""
    from regionframe.operators.agglomerate import TwoGroupsOf, six_neighbours

    points = [(i, j, 0) for i in range(3) for j in range(2)] + [(9, 0, 0), (9, 1, 0)]
    r = np.random.default_rng(11)
    x, group = r.normal(size=(len(points), 12, 2)), np.arange(12) % 2
    x[1] = x[0]  # equal costs
    rows = []
    for v in range(len(points)):
        row = []
        for g in (0, 1):
            y = x[v, group == g]
            row += [len(y), *y.sum(0), *(y.T @ y).ravel()]
        rows.append(row)
    edges = six_neighbours(points)
    got = agglomerate(np.array(rows, float), edges, TwoGroupsOf(2))

    def det(voxels):
        values, c, n = x[sorted(voxels)], 0, 0
        for g in (0, 1):
            y = values[:, group == g].reshape(-1, 2)
            c, n = c + len(y) * np.cov(y.T, ddof=0), n + len(y)
        return float(np.linalg.det(c / n)) * len(voxels)

    regions, parent, links = {v: {v} for v in range(len(points))}, {}, {frozenset(e) for e in edges}
    alive, number = set(regions), len(points)
    while links:
        costs = sorted((det(regions[a] | regions[b]) - det(regions[a]) - det(regions[b]), a, b) for a, b in (sorted(e) for e in links))
        near = [c for c in costs if c[0] < costs[0][0] + 1e-12]
        _, a, b = min(near, key=lambda c: c[1:])
        regions[number] = regions[a] | regions[b]
        parent[a] = parent[b] = number
        alive = alive - {a, b} | {number}
        links = {frozenset(number if z in (a, b) else z for z in e) for e in links}
        links = {e for e in links if len(e) == 2}
        number += 1
    assert [g[1] for g in got] == [parent.get(v) for v in range(number)] and sum(g[1] is None for g in got) == 2
    whole = x[:6].transpose(1, 0, 2)
    a, b = (whole[group == g].reshape(-1, 2) for g in (0, 1))
    pooled = (len(a) * np.cov(a.T, ddof=0) + len(b) * np.cov(b.T, ddof=0)) / (len(a) + len(b))
    d = b.mean(0) - a.mean(0)
    top = next(g for g in got if g[1] is None and g[2] == 6)
    assert top[3] == pytest.approx(d @ np.linalg.inv(pooled) @ d * len(a) * len(b) / (len(a) + len(b)))


def test_merge_tree_merges_what_is_cheapest_for_both(spark):
    """The distributed loop on a path of four and one of two: a forest, children below parents, sums of sizes."""
    from pyspark.sql import functions as F

    from regionframe.operators.agglomerate import merge_tree

    stats = spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate((0, 1, 10, 11.5, 50, 50))], "node int, size int, s double")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "src int, dst int")

    def costs(s, e):
        side = lambda k: s.select(F.col("node").alias(k), (F.col("s") / F.col("size")).alias(f"m{k}"))
        return e.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", F.abs(F.col("msrc") - F.col("mdst")).alias("cost"))

    t = {r.node: r for r in merge_tree(stats, edges, costs, ["s"]).collect()}
    assert t[0].parent == t[1].parent and t[2].parent == t[3].parent and t[4].parent == t[5].parent and t[t[0].parent]["round"] == 1
    assert t[t[0].parent].parent == t[t[2].parent].parent and t[t[t[0].parent].parent].size == 4 and sum(r.parent is None for r in t.values()) == 2
    assert all(r.parent is None or r.parent > r.node for r in t.values()) and len(t) == 10


def test_error_rates_and_grids_are_checked(tmp_path, spark):
    from regionframe.jobs.permutation import alpha_allowed
    from regionframe.sources.volumes import encode_nifti, read_volumes, same_space, write_file

    alpha_allowed(0.05, 19)
    with pytest.raises(ValueError):
        alpha_allowed(0.04, 20)
    eye = np.eye(4)
    assert same_space(((2, 3), eye), ((2, 3), eye + 1e-10)) and not same_space(((2, 3), eye), ((2, 3), 2 * eye)) and not same_space(((2, 3), eye), ((3, 2), eye))
    write_file(f"{tmp_path}", "a.nii.gz", encode_nifti(np.ones((2, 2, 2)), eye))
    write_file(f"{tmp_path}", "b.nii.gz", encode_nifti(np.ones((2, 2, 2)), 3 * eye))
    files = spark.createDataFrame([("a", "x", "a.nii.gz"), ("b", "x", "b.nii.gz")], "sbj string, feat string, path string")
    assert read_volumes(spark, files, [f"{tmp_path}/a.nii.gz"]).count() == 8
    with pytest.raises(Exception, match="another grid"):
        read_volumes(spark, files, [str(tmp_path)]).collect()
