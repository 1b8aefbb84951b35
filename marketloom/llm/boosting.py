"""Gradient-boosted trees for yes/no labels: histogram splits, logistic loss, complete trees of fixed depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.slope, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node, size = np.zeros(len(y), np.int64), 2**self.depth - 1
            feature, cut = np.zeros(size, np.int64), np.full(size, np.inf)
            for at in range(size):
                rows = np.flatnonzero(node == at)
                best = 1e-6
                for f in range(x.shape[1]) if len(rows) > 1 else ():
                    gs = np.cumsum(np.bincount(binned[rows, f], g[rows], self.bins))
                    hs = np.cumsum(np.bincount(binned[rows, f], h[rows], self.bins))
                    gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    k = int(np.argmax(gain[: len(cuts[f])])) if len(cuts[f]) else -1
                    if k >= 0 and gain[k] > best:
                        best, feature[at], cut[at] = gain[k], f, cuts[f][k]
                node[rows] = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            leaf = node - size
            value = -self.rate * np.bincount(leaf, g, size + 1) / (np.bincount(leaf, h, size + 1) + 1)
            self.trees.append((feature, cut, value))
            raw += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, size = np.full(len(x), self.start), 2**self.depth - 1
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - size]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Slope and shift of the raw score for rows that the trees haven't seen (Platt)."""
        r = self.raw(x)
        for _ in range(200):
            p = 1 / (1 + np.exp(-(self.slope * r + self.shift)))
            self.slope -= 0.1 * float(np.mean((p - y) * r)) / (1 + float(np.mean(r * r)))
            self.shift -= 0.5 * float(np.mean(p - y))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))
