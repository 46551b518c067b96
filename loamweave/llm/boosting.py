"""Gradient-boosted trees for binary targets on a few dense features."""

from __future__ import annotations

import numpy as np


class Boosting:
    """Depth-limited regression trees on binned features, fitted to the logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32) -> None:
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.start, self.edges, self.forest = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(b, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.forest.append(tree)
            score += self._follow(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int):
        total_g, total_h = g[at].sum(), h[at].sum()
        best = (1e-6, None, None)
        if depth and len(at) >= 10:
            for f in range(b.shape[1]):
                size = len(self.edges[f]) + 1
                left_g = np.cumsum(np.bincount(b[at, f], g[at], size))[:-1]
                left_h = np.cumsum(np.bincount(b[at, f], h[at], size))[:-1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            return self.rate * total_g / (total_h + 1)
        _, f, cut = best
        low = b[at, f] <= cut
        return f, cut, self._grow(b, g, h, at[low], depth - 1), self._grow(b, g, h, at[~low], depth - 1)

    def _follow(self, tree, b: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        f, cut, low, high = tree
        return np.where(b[:, f] <= cut, self._follow(low, b), self._follow(high, b))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._binned(x)
        return 1 / (1 + np.exp(-(self.start + sum(self._follow(t, b) for t in self.forest))))
