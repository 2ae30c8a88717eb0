"""Enhancement of clusters without a threshold, cut into blocks of the grid: no task holds an image.

Components at a level are those of its blocks, joined where they touch over a border. A block finds its own components of
all levels by one union-find as levels fall, and hands on only what its border voxels are in; those meet as rows (perm, level,
component), connected by joins; their sizes over all blocks go back to the blocks, which add up their voxels' enhancement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionframe.operators.components import connected
from regionframe.operators.grid import IJK, THREE, shifted
from regionframe.sources.cut import cut

BLOCK = ["bi", "bj", "bk"]
EDGE = 32  # voxels a side of a block
STEPS = 100
WITHIN = 1e-12  # a value so far below a level counts as at it


def levelled(images: DataFrame, value: str, steps: int = STEPS) -> DataFrame:
    """images (perm, i, j, k, value) with step, a hundredth of the image's largest value, and level, how many of the multiples of
    step the value reaches: 0 for nulls, NaN and where the largest value is not above 0."""
    known = F.when(~F.isnan(value), F.col(value))
    step = images.groupBy("perm").agg((F.max(known) / steps).alias("step"))
    d = images.join(step, "perm").withColumn("near", F.floor(known / F.col("step")))
    reached = [F.when(n * F.col("step") - WITHIN <= known, n) for n in (F.col("near") + 1, F.col("near"), F.col("near") - 1)]
    level = F.least(F.greatest(F.coalesce(*reached, F.lit(0)), F.lit(0)), F.lit(steps))
    return d.withColumn("level", F.when(F.col("step") > 0, level).otherwise(0).cast("int")).drop("near")


def components_as_levels_fall(ijk: np.ndarray, level: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from the highest down to 1: (level, the voxels that reach it, each one's component, components' sizes). A
    component is named by its first voxel, sizes are by name. The smaller of two that meet takes the other's name before
    names are set right, so that each voxel moves log2(voxels) times at most."""
    at = {p: n for n, p in enumerate(map(tuple, ijk.tolist()))}
    near = [[at[q] for d in THREE for s in (1, -1) if (q := (p[0] + s * d[0], p[1] + s * d[1], p[2] + s * d[2])) in at] for p in at]
    label, members = np.arange(len(ijk)), [[n] for n in range(len(ijk))]
    name, size, alive = np.arange(len(ijk)), np.ones(len(ijk), np.int64), np.zeros(len(ijk), bool)
    order = np.argsort(-level, kind="stable")
    done = 0
    for k in range(int(level.max(initial=0)), 0, -1):
        while done < len(order) and level[order[done]] >= k:
            v = int(order[done])
            alive[v], done = True, done + 1
            for u in near[v]:
                a, b = label[v], label[u]
                if alive[u] and a != b:
                    if len(members[a]) < len(members[b]):
                        a, b = b, a
                    label[members[b]] = a
                    members[a] += members[b]
                    members[b] = []
                    name[a] = min(name[a], name[b])
                    size[a] += size[b]
        here = np.flatnonzero(alive)
        yield k, here, name[label[here]], size[label[here]]


def _sorted(f: pd.DataFrame) -> pd.DataFrame:
    return f.sort_values(IJK).reset_index(drop=True)


def _border(edge: int):
    def border(f: pd.DataFrame) -> pd.DataFrame:
        """Each border voxel at each level that it reaches: its component in the block, named by a voxel, and that one's size."""
        f, out = _sorted(f), []
        ijk = f[IJK].to_numpy(np.int64)
        outer = ((ijk % edge == 0) | (ijk % edge == edge - 1)).any(axis=1)
        for k, here, names, sizes in components_as_levels_fall(ijk, f["level"].to_numpy()):
            some = outer[here]
            rows = pd.DataFrame(ijk[here[some]], columns=IJK).assign(level=k, size=sizes[some])
            rows[["ci", "cj", "ck"]] = ijk[names[some]]
            out.append(rows)
        columns = [*IJK, "level", "ci", "cj", "ck", "size"]
        got = pd.concat(out) if out else pd.DataFrame(columns=columns, dtype="int64")
        return got.assign(perm=f["perm"].iloc[0])[["perm", *columns]]

    return border


def _enhance(h: float, e: float):
    def enhance(f: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
        f = _sorted(f)
        ijk, out = f[IJK].to_numpy(np.int64), np.zeros(len(f))
        if len(f):
            at = {p: n for n, p in enumerate(map(tuple, ijk.tolist()))}
            whole = {level: {} for level in range(STEPS + 1)}
            for level, i, j, k, n in sizes[["level", "ci", "cj", "ck", "size"]].itertuples(index=False, name=None):
                whole[level][at[i, j, k]] = n
            step = float(f["step"].iloc[0]) if len(f) else 0.0
            for level, here, names, own in components_as_levels_fall(ijk, f["level"].to_numpy()):
                size = own.astype(float)
                if whole[level]:
                    total = np.zeros(len(f))
                    total[list(whole[level])] = list(whole[level].values())
                    size = np.where(total[names] > 0, total[names], size)
                out[here] += size**e * (level * step) ** h * step
        return f.assign(tfce=out)[["perm", *IJK, "value", "tfce"]]

    return enhance


def enhanced(images: DataFrame, value: str, edge: int = EDGE, h: float = 2.0, e: float = 0.5) -> DataFrame:
    """(perm, i, j, k, value, tfce) of images (perm, i, j, k, value): for each voxel the sum over levels up to its value of (size
    of its component at the level)^e * level^h * step, components by six neighbours over the whole image.

    A task holds a block of edge³ voxels. What crosses blocks is a row a border voxel and level; components over blocks are
    connected in rounds that grow with the log of the blocks they run through. A null or NaN value reaches no level and has 0; an
    image without a value above 0 has 0 throughout, one of a single block makes no links. Voxels are there once each."""
    d = images.select("perm", *IJK, F.col(value).cast("double").alias("value"))
    d = levelled(d, "value").withColumns({b: F.floor(F.col(c) / edge).cast("int") for b, c in zip(BLOCK, IJK, strict=True)})
    d = cut(d.select("perm", *IJK, *BLOCK, "value", "level", F.col("step")))
    kinds = "perm int, i int, j int, k int, level int, ci int, cj int, ck int, size long"
    border = cut(d.where("level > 0").groupBy("perm", *BLOCK).applyInPandas(_border(edge), kinds))
    component = F.struct("perm", "level", "ci", "cj", "ck")
    moved = shifted(border.select(*IJK, component.alias("src")).withColumns({"perm": F.col("src.perm"), "level": F.col("src.level")}), THREE, "src", "perm", "level")
    links = moved.join(border.select("perm", "level", *IJK, component.alias("dst")), ["perm", "level", *IJK]).where("src <> dst").select("src", "dst").distinct()
    links = cut(links)
    joined = connected(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct(), links)
    own = joined.join(border.select(component.alias("node"), "size").distinct(), "node")
    total = own.groupBy("label").agg(F.sum("size").alias("size"))
    sizes = own.select("node", "label").join(total, "label").select("node.*", "size")
    sizes = sizes.withColumns({b: F.floor(F.col(c) / edge).cast("int") for b, c in zip(BLOCK, ("ci", "cj", "ck"), strict=True)})
    out = d.groupBy("perm", *BLOCK).cogroup(sizes.groupBy("perm", *BLOCK)).applyInPandas(_enhance(h, e), "perm int, i int, j int, k int, value double, tfce double")
    return out.withColumnRenamed("value", value)
