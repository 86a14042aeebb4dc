"""A small random forest in numpy, for classifiers whose training set is bounded."""

from __future__ import annotations

import numpy as np


class RandomForest:
    """Binary classification: bootstrapped trees on random feature subsets, split by Gini impurity."""

    def __init__(self, trees: int = 40, depth: int = 8, least: int = 2, seed: int = 0):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> RandomForest:
        rng = np.random.default_rng(self.seed)
        self.nodes = [self._tree(x[i], y[i], rng) for i in (rng.integers(0, len(x), len(x)) for _ in range(self.trees))]
        return self

    def _tree(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, value = [], [], [], [], []

        def grow(rows: np.ndarray, depth: int) -> int:
            node = len(feature)
            for store, v in ((feature, -1), (cut, 0.0), (left, -1), (right, -1), (value, float(y[rows].mean()))):
                store.append(v)
            if depth == 0 or len(rows) < 2 * self.least or value[node] in (0.0, 1.0):
                return node
            best = (np.inf, -1, 0.0)
            for f in rng.permutation(x.shape[1])[: max(1, int(np.sqrt(x.shape[1])) + 1)]:
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows[order], f], np.cumsum(y[rows[order]])
                n = np.arange(1, len(rows) + 1)
                ok = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= self.least) & (len(rows) - n[:-1] >= self.least))
                if len(ok):
                    a, b = t[ok] / n[ok], (t[-1] - t[ok]) / (len(rows) - n[ok])
                    gini = n[ok] * a * (1 - a) + (len(rows) - n[ok]) * b * (1 - b)
                    i = int(gini.argmin())
                    if gini[i] < best[0] - 1e-12:
                        best = (gini[i], int(f), float((v[ok[i]] + v[ok[i] + 1]) / 2))
            if best[1] < 0:
                return node
            feature[node], cut[node] = best[1], best[2]
            low = x[rows, best[1]] <= best[2]
            left[node] = grow(rows[low], depth - 1)
            right[node] = grow(rows[~low], depth - 1)
            return node

        grow(np.arange(len(x)), self.depth)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The share of the positive class, averaged over the trees."""
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += value[at]
        return total / max(1, len(self.nodes))
