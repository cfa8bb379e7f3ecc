"""Gradient-boosted trees for a binary label, with numpy: quantile bins, depth-wise trees, Newton leaves."""

from __future__ import annotations

import numpy as np


class Boosted:
    """``trees`` trees of ``depth`` levels; ``margin`` gives log-odds."""

    def __init__(self, trees: int = 60, depth: int = 4, bins: int = 24, rate: float = 0.25, ridge: float = 2.0):
        self.trees, self.depth, self.bins, self.rate, self.ridge = trees, depth, bins, rate, ridge

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], cuts)) for j in range(x.shape[1])]
        # an edge at the greatest value would leave nothing above it
        self.edges = [e[e < x[:, j].max()] if len(x) else e for j, e in enumerate(self.edges)]
        b, n, width = self._binned(x), x.shape[1], self.bins + 1
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin = np.full(len(y), self.start)
        self.features = np.zeros((self.trees, 2**self.depth), np.int32)
        self.cuts = np.full((self.trees, 2**self.depth), width, np.int16)  # nothing lies above: all go left
        self.leaves = np.zeros((self.trees, 2**self.depth))
        offsets = np.arange(n) * width
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.ones(len(y), np.int64)
            for _ in range(self.depth):
                for k in np.unique(node):
                    at = np.flatnonzero(node == k)
                    flat = (b[at] + offsets).ravel()
                    gs = np.bincount(flat, np.repeat(g[at], n), n * width).reshape(n, width).cumsum(axis=1)
                    hs = np.bincount(flat, np.repeat(h[at], n), n * width).reshape(n, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    best = int(gain.argmax())
                    if gain.ravel()[best] > 1e-6:
                        self.features[t, k], self.cuts[t, k] = divmod(best, width)
                node = 2 * node + (b[np.arange(len(y)), self.features[t, node]] > self.cuts[t, node])
            leaf = node - 2**self.depth
            size = 2**self.depth
            self.leaves[t] = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.ridge)
            margin += self.leaves[t, leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        used, columns = np.unique(self.features, return_inverse=True)
        features = columns.reshape(self.features.shape)
        b = np.stack([np.searchsorted(self.edges[j], x[:, j], "left") for j in used], axis=1).astype(np.uint8)
        # rows that fall into the same bins go the same way
        _, first, again = np.unique(b.view(np.dtype((np.void, b.shape[1]))).ravel(), return_index=True, return_inverse=True)
        b = b[first].ravel()
        rows, out = np.arange(len(first)) * len(used), np.full(len(first), self.start)
        for t in range(self.trees):
            node = np.ones(len(first), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (b[rows + features[t, node]] > self.cuts[t, node])
            out += self.leaves[t, node - 2**self.depth]
        return out[again.ravel()]
