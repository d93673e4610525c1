"""Gradient-boosted trees for two classes and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Depth-wise trees over binned features, fitted to the logistic loss.

    Deterministic: no sampling, and equal gains go to the first feature and edge.
    """

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 1.0):
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        raw = np.full(n, self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature = np.zeros(2**self.depth - 1, np.int64)
            cut = np.full(2**self.depth - 1, BINS, np.int64)  # a cut at the last bin sends all rows left
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-9)
                for f in range(width):
                    cell = (at - first) * BINS + binned[:, f]
                    gs = np.bincount(cell, g, many * BINS).reshape(many, BINS).cumsum(axis=1)
                    hs = np.bincount(cell, h, many * BINS).reshape(many, BINS).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain = np.where((hs >= self.least) & (ht - hs >= self.least), gain, 0)
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(many), k]
                    better = top > best
                    best[better], feature[first : first + many][better], cut[first : first + many][better] = top[better], f, k[better]
                at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > cut[at])
            leaf = at - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            raw += value[leaf]
            self.nodes.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out


class Isotonic:
    """Monotone map from raw scores to probabilities by pooling adjacent violators.

    Between the middles of pooled blocks it is linear; a small share of the raw
    probability keeps the order of scores within a block.
    """

    SHARE = 0.01

    def fit(self, raw: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
        weight = np.ones(len(y)) if weight is None else weight
        order = np.lexsort((weight, -y, raw))  # ones first among equal scores, so that these are pooled
        blocks: list[list[float]] = []  # mean, weight, sum of raw
        for r, v, w in zip(raw[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
            blocks.append([v, w, r * w])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                v1, w1, r1 = blocks.pop()
                v0, w0, r0 = blocks[-1]
                blocks[-1] = [(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, r0 + r1]
        self.at = np.array([b[2] / b[1] for b in blocks])
        self.value = np.array([b[0] for b in blocks])
        return self

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return (1 - self.SHARE) * np.interp(raw, self.at, self.value) + self.SHARE / (1 + np.exp(-raw))
