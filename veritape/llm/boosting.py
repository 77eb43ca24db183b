"""Gradient-boosted regression trees with logistic loss, in numpy, for small feature tables."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees over at most ``bins`` quantile bins a feature, and a Platt calibration of their margin.

    ``fit`` is deterministic. With fewer than two classes the model predicts the one class's rate.
    """

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, leaf: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.leaf = trees, depth, rate, bins, leaf
        self.edges: list[np.ndarray] = []
        self.forest: list[list] = []
        self.base, self.platt = 0.0, (1.0, 0.0)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = self.rate * total_g / (total_h + self.leaf)
        if depth == 0 or len(rows) < 8:
            return value
        best, at = 1e-6, None
        for j in range(b.shape[1]):
            n = len(self.edges[j]) + 1
            sg = np.bincount(b[rows, j], weights=g[rows], minlength=n).cumsum()[:-1]
            sh = np.bincount(b[rows, j], weights=h[rows], minlength=n).cumsum()[:-1]
            if not len(sg):
                continue
            gain = sg**2 / (sh + self.leaf) + (total_g - sg) ** 2 / (total_h - sh + self.leaf) - total_g**2 / (total_h + self.leaf)
            if gain.max() > best:
                best, at = gain.max(), (j, int(gain.argmax()))
        if at is None:
            return value
        left = b[rows, at[0]] <= at[1]
        return (*at, self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1))

    def _walk(self, tree, b: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            out[rows] += tree
            return
        j, cut, low, high = tree
        left = b[rows, j] <= cut
        self._walk(low, b, rows[left], out)
        self._walk(high, b, rows[~left], out)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Four fifths of the rows grow the trees, each fifth row calibrates."""
        hold = np.arange(len(y)) % 5 == 4
        p = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if len(np.unique(y[~hold])) < 2:
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="higher")) for j in range(x.shape[1])]
        b, grow = self._binned(x), np.flatnonzero(~hold)
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(b, y - q, q * (1 - q), grow, self.depth)
            self.forest.append(tree)
            self._walk(tree, b, np.arange(len(y)), f)
        if len(np.unique(y[hold])) == 2:
            self.platt = _platt(f[hold], y[hold])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if self.forest:
            b = self._binned(x)
            for tree in self.forest:
                self._walk(tree, b, np.arange(len(x)), f)
        a, c = self.platt
        return 1 / (1 + np.exp(-np.clip(a * f + c, -50, 50)))


def _platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for p = sigmoid(a f + c) on smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t, w = np.where(y > 0, hi, lo), np.array([1.0, 0.0])
    m = np.stack([f, np.ones_like(f)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -50, 50)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-6 * np.eye(2), m.T @ (t - p))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)
