"""Gradient-boosted decision trees with a logistic loss, in numpy; for small tables of features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees: in each inner node a feature and a limit (left if not above), in each leaf a value."""

    features: np.ndarray
    limits: np.ndarray
    values: np.ndarray
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.values.shape[1]))
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.features, self.limits, self.values, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - (value.size - 1)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> Trees:
    """Fit the trees one after the other on the loss's gradient, splits at quantiles of each feature."""
    inner, leaves = 2**depth - 1, 2**depth
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), float(np.log(share / (1 - share))))
    if not len(y):
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    total = np.full(len(y), out.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p) + 1e-6
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                best, choice = 1e-9, None
                whole = g[rows].sum() ** 2 / (h[rows].sum() + least)
                for j, e in enumerate(edges):
                    gs = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))
                    hs = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))
                    gain = gs**2 / (hs + least) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + least) - whole
                    b = int(gain[: len(e)].argmax())
                    if gain[b] > best:
                        best, choice = gain[b], (j, b)
                if choice:
                    out.features[t, k], out.limits[t, k] = choice[0], edges[choice[0]][choice[1]]
                node[rows] = 2 * k + 1 + (x[rows, out.features[t, k]] > out.limits[t, k])
        leaf = node - inner
        out.values[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + least)
        total += out.values[t][leaf]
    return out
