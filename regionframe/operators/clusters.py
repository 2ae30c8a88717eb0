"""Kernels on one image's volume: enhancement of clusters without a threshold, and mask sampling."""

from __future__ import annotations

import numpy as np

SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def _neighbours(points: list[tuple]) -> list[list[int]]:
    at = {p: i for i, p in enumerate(points)}
    return [[at[q] for d in SIX if (q := tuple(a + b for a, b in zip(p, d, strict=True))) in at] for p in points]


def tfce(points: list[tuple], values: np.ndarray, h: float = 2.0, e: float = 0.5, steps: int = 100) -> np.ndarray:
    """For each voxel the sum over thresholds up to its value of (its component's size at the threshold)^e * threshold^h *
    step; the step is a hundredth of the largest value. Thresholds fall, so components only grow: one union-find."""
    out = np.zeros(len(points))
    top = float(np.nanmax(values, initial=0.0))
    if top <= 0:
        return out
    near, step = _neighbours(points), top / steps
    up, size, alive = list(range(len(points))), [1] * len(points), np.zeros(len(points), bool)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k in range(steps, 0, -1):
        level = k * step
        for i in np.flatnonzero((values >= level - 1e-12) & ~alive).tolist():
            alive[i] = True
            for j in near[i]:
                if alive[j] and (a := root(i)) != (b := root(j)):
                    up[b] = a
                    size[a] += size[b]
        for i in np.flatnonzero(alive).tolist():
            out[i] += size[root(i)] ** e * level**h * step
    return out


def grown_mask(points: list[tuple], seed_voxel: int, num_vox: int, order: np.ndarray) -> list[int]:
    """A compact mask of num_vox voxels: shells of neighbours around the seed voxel, the last shell filled by `order`. Less
    where the component is smaller."""
    near, mask, shell = _neighbours(points), {seed_voxel}, {seed_voxel}
    while len(mask) < num_vox:
        shell = {j for i in shell for j in near[i]} - mask
        if not shell:
            break
        mask |= set(sorted(shell, key=lambda i: (order[i], i))[: num_vox - len(mask)])
    return sorted(mask)


def min_variance_mask(points: list[tuple], moments: np.ndarray, seed_voxel: int, num_vox: int) -> list[int]:
    """Grown from the seed voxel by the neighbour that leaves the least variance of all chosen; moments: (n, s, q)."""
    near, mask, total = _neighbours(points), {seed_voxel}, moments[seed_voxel].astype(float).copy()
    while len(mask) < num_vox:
        rim = sorted({j for i in mask for j in near[i]} - mask)
        if not rim:
            break
        m = total + moments[rim]
        best = rim[int(np.argmin(np.round(m[:, 2] / m[:, 0] - (m[:, 1] / m[:, 0]) ** 2, 12)))]
        mask.add(best)
        total += moments[best]
    return sorted(mask)
