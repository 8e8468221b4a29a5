"""Gradient boosted trees for small tables: Newton steps on the logistic loss over binned features, with Platt calibration."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.slope, self.shift, self.threshold = 0.0, 1.0, 0.0, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            raw += self._grow(binned, cuts, p - y, p * (1 - p))
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Adds a complete tree in heap order; a node that gains nothing sends all its rows to the left."""
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(g), np.int64)
        for k in range(inner):
            rows = np.nonzero(node == k)[0]
            best, chosen = 1e-6, None
            if len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                    gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, chosen = float(gain[i]), (f, i)
            right = np.zeros(len(rows), bool)
            if chosen:
                feature[k], cut[k] = chosen[0], cuts[chosen[0]][chosen[1]]
                right = binned[rows, chosen[0]] > chosen[1]
            node[rows] = 2 * k + 1 + right
        leaf = node - inner
        value = -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.l2)
        self.grown.append((feature, cut, value))
        return value[leaf]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.grown:
            node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> BoostedTrees:
        """Fits a sigmoid to held-out rows and takes the lowest threshold whose precision there is as asked."""
        raw = self.raw(x)
        self.slope, self.shift = platt(raw, y)
        p, order = self.probability(x), np.argsort(-raw)
        hits = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        enough = np.nonzero(hits >= precision)[0]
        self.threshold = float(p[order][enough[-1]]) if len(enough) else 1.0
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -50, 50)))


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """slope, shift of the sigmoid that fits y best, by damped Newton steps with smoothed targets."""
    positive = float(y.sum())
    t = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (len(y) - positive + 2))
    w = np.array([1.0, 0.0])
    z = np.stack([raw, np.ones(len(raw))], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, z.T @ (p - t)), -1, 1)
    return float(w[0]), float(w[1])
