"""Components: the library's for tables, and a forest for the links that one task has found."""

from __future__ import annotations

import numpy as np

from loam.operators.components import connected_components, heavy_keys, looked_up

__all__ = ["connected_components", "forest", "heavy_keys", "looked_up"]


def forest(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """For n points and links between them: each point's smallest linked index, over any number of links."""
    root = np.arange(n)
    while len(rows):
        a, b = root[rows], root[columns]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return root
