"""Gradient-boosted trees in numpy: small models, fitted on the driver, applied in tasks.

The trees are oblivious: all nodes of a level share one test, so a row's leaf is
a number made of the tests' bits.
"""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """A binary classifier with logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 2.0):
        self.trees, self.depth, self.rate, self.l2 = trees, depth, rate, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.int64)
        # A feature's bins beyond its edges are no cuts.
        cuts_of = np.arange(BINS)[None, :] < np.array([len(e) for e in self.edges])[:, None]
        places = (binned + np.arange(d)[:, None] * BINS).ravel()
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        score = np.full(n, self.start)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = prob - y, prob * (1 - prob)
            all_g, all_h = np.tile(g, d), np.tile(h, d)
            leaf = np.zeros(n, np.int64)
            features, bins = [], []
            for level in range(self.depth):
                at = places + np.tile(leaf * (d * BINS), d)
                shape = (1 << level, d, BINS)
                gs = np.bincount(at, all_g, np.prod(shape)).reshape(shape).cumsum(2)
                hs = np.bincount(at, all_h, np.prod(shape)).reshape(shape).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = (gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2)).sum(0)
                j, k = divmod(int(np.where(cuts_of, gain, -np.inf).argmax()), BINS)
                leaf = leaf * 2 + (binned[j] > k)
                features.append(j)
                bins.append(k)
            size = 1 << self.depth
            values = -self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.l2)
            cuts = np.array([self.edges[j][k] if len(self.edges[j]) else np.inf for j, k in zip(features, bins)])
            self.model.append((np.array(features), cuts, values))
            score += values[leaf]
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for features, cuts, values in self.model:
            leaf = np.zeros(len(x), np.int64)
            for j, cut in zip(features, cuts):
                leaf = leaf * 2 + (x[:, j] > cut)
            out += values[leaf]
        return out
