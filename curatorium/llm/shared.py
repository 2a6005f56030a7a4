"""What the operators share: written tables and connected components."""

from __future__ import annotations

import numpy as np

from curatorium.operators.graph import components, freed, shared_dir, written

__all__ = ["components", "forest", "freed", "shared_dir", "written"]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) of small integers to keep so that the same are connected."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    keep = np.zeros(len(a), dtype=bool)
    for k, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        u, v = root(u), root(v)
        if u != v:
            parent[u] = v
            keep[k] = True
    return keep
