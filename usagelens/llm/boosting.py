"""Gradient-boosted trees for a yes-or-no label, on binned features in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """An ensemble of trees of one depth; a tree is its split features, split bins and leaf values."""

    def __init__(self, edges: list[np.ndarray], base: float, depth: int):
        self.edges, self.base, self.depth = edges, base, depth
        self.features: list[np.ndarray] = []
        self.bins: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for f, e in enumerate(self.edges):
            out[:, f] = np.searchsorted(e, x[:, f], side="right")
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.binned(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        for features, bins, leaves in zip(self.features, self.bins, self.leaves):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, features[at]] > bins[at])
            total += leaves[at - (2**self.depth - 1)]
        return total

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, ridge: float = 2.0) -> Trees:
    """Newton boosting on the log loss; at each node the split with the largest gain."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Trees(edges, float(np.log(mean / (1 - mean))), depth)
    b, n_f = model.binned(x).astype(np.int64), x.shape[1]
    flat = b + np.arange(n_f) * BINS
    z = np.full(len(x), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        features, bins = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
        at = np.zeros(len(x), np.int64)
        for node in range(2**depth - 1):
            own = np.flatnonzero(at == node)
            if len(own) >= 8:
                keys = flat[own].ravel()
                gs = np.bincount(keys, np.repeat(g[own], n_f), n_f * BINS).reshape(n_f, BINS).cumsum(axis=1)
                hs = np.bincount(keys, np.repeat(h[own], n_f), n_f * BINS).reshape(n_f, BINS).cumsum(axis=1)
                ga, ha = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                gain[:, -1] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    features[node], bins[node] = divmod(best, BINS)
            at[own] = 2 * node + 1 + (b[own, features[node]] > bins[node])
        leaf = at - (2**depth - 1)
        gs, hs = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        values = rate * gs / (hs + ridge)
        z += values[leaf]
        model.features.append(features)
        model.bins.append(bins)
        model.leaves.append(values)
    return model
