"""Every registered query of the region-analysis part, and its oracle."""

from __future__ import annotations

from regionframe.jobs import designs, files, graph, inference, masks, metrics, moments, permutation, polynomial, regress, regress_vba, replay, rounds, tours, trees, volumes, voxelwise

_PARTS = [voxelwise, moments, masks, graph, permutation, regress, metrics, trees, inference, regress_vba, volumes, polynomial, replay, tours, designs, rounds, files]

QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
