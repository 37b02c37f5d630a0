"""Small gradient-boosted trees for two classes: trained on the driver, scored in batches anywhere."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth under logistic loss, with second-order leaf values. Ties in split gain go to the first feature and threshold."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0, cuts: int = 32):
        self.n_trees, self.depth, self.rate, self.l2, self.cuts = trees, depth, rate, l2, cuts
        self.features: list[np.ndarray] = []
        self.limits: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, m = x.shape
        limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 1)[1:-1], method="lower")) for j in range(m)]
        codes = np.stack([np.searchsorted(limits[j], x[:, j], side="left") for j in range(m)], axis=1)
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(n, self.start)
        inner = 2**self.depth - 1
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(n, np.int64)
            for at in range(inner):
                rows = np.flatnonzero(node == at)
                best = 1e-9
                g_all, h_all = grad[rows].sum(), hess[rows].sum()
                for j in range(m):
                    k = len(limits[j])
                    if not k or not len(rows):
                        continue
                    g = np.cumsum(np.bincount(codes[rows, j], grad[rows], k + 1))[:-1]
                    h = np.cumsum(np.bincount(codes[rows, j], hess[rows], k + 1))[:-1]
                    gain = g**2 / (h + self.l2) + (g_all - g) ** 2 / (h_all - h + self.l2) - g_all**2 / (h_all + self.l2)
                    c = int(np.argmax(gain))
                    if gain[c] > best:
                        best, feature[at], limit[at] = gain[c], j, limits[j][c]
                node[rows] = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            leaf = node - inner
            g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
            values = self.rate * g / (h + self.l2)
            margin += values[leaf]
            self.features.append(feature)
            self.limits.append(limit)
            self.leaves.append(values)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.start)
        inner, rows = 2**self.depth - 1, np.arange(len(x))
        for feature, limit, values in zip(self.features, self.limits, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            margin += values[node - inner]
        return 1 / (1 + np.exp(-margin))
