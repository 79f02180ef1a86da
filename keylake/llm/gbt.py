"""Gradient-boosted trees on histograms, with monotonic constraints, kept as flat numpy node arrays.

Training takes a bounded sample; scoring walks all rows of a batch through each tree at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete trees of one depth: node i has children 2i+1 and 2i+2. A node that doesn't split has threshold inf."""

    feature: np.ndarray  # [trees, inner nodes]
    threshold: np.ndarray  # [trees, inner nodes]
    value: np.ndarray  # [trees, leaves]
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between distinct values, at most bins - 1 of them."""
    found = np.unique(column)
    if len(found) > bins:
        found = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (found[:-1] + found[1:]) / 2


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, monotone: dict[int, int] | None = None, least: float = 5.0, l2: float = 1.0) -> Forest:
    """Logistic boosting of y (0 or 1) on x.

    monotone maps a feature to +1 (the margin never falls as it grows) or -1. An empty sample or one of a single
    class gives a constant forest.
    """
    monotone = monotone or {}
    inner, leaves = 2**depth - 1, 2**depth
    rate_of_1 = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    forest = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(rate_of_1 / (1 - rate_of_1))))
    if not len(y) or y.min() == y.max():
        return forest
    edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), forest.base)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        cut = np.full(inner, bins + 1)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            sums = np.stack([np.bincount(at, w, width) for w in (grad, hess)])
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                n = len(e) + 1
                g, h = (np.bincount(at * n + binned[:, j], w, width * n).reshape(width, n).cumsum(1)[:, :-1] for w in (grad, hess))
                g2, h2 = sums[0][:, None] - g, sums[1][:, None] - h
                bound = lambda w, k: np.clip(w, low[first : first + width, None], high[first : first + width, None])  # noqa: E731, B023
                a, b = bound(g / (h + l2), 0), bound(g2 / (h2 + l2), 0)
                whole = np.clip(sums[0] / (sums[1] + l2), low[first : first + width], high[first : first + width])
                score = lambda g, h, w: g * w - (h + l2) * w * w / 2
                gain = score(g, h, a) + score(g2, h2, b) - score(sums[0], sums[1], whole)[:, None]
                ok = (h >= least / 4) & (h2 >= least / 4)
                if monotone.get(j):
                    ok &= (b - a) * monotone[j] >= 0
                gain = np.where(ok, gain, -1.0)
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                for i in np.flatnonzero(better):
                    best[i] = gain[i, k[i]]
                    feature[first + i], threshold[first + i], cut[first + i] = j, e[k[i]], k[i]
            for i in range(first, first + width):
                left, right = 2 * i + 1, 2 * i + 2
                low[left] = low[right] = low[i]
                high[left] = high[right] = high[i]
                if np.isfinite(threshold[i]) and monotone.get(int(feature[i])):
                    here = node == i
                    goes = here & (binned[:, feature[i]] > cut[i])
                    stays = here & ~goes
                    a, b = (np.clip(grad[m].sum() / (hess[m].sum() + l2), low[i], high[i]) for m in (stays, goes))
                    middle = (a + b) / 2
                    if monotone[int(feature[i])] > 0:
                        high[left] = low[right] = middle
                    else:
                        low[left] = high[right] = middle
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        g, h = (np.bincount(leaf, w, leaves) for w in (grad, hess))
        value = rate * np.clip(g / (h + l2), low[inner:], high[inner:])
        margin += value[leaf]
        grown.append((feature, threshold, value))
    forest.feature, forest.threshold, forest.value = (np.stack(z) for z in zip(*grown, strict=True))
    return forest
