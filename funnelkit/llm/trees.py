"""Histogram-binned trees in numpy: one classification tree, gradient-boosted
trees, and flat arrays that score all rows level by level."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Flat:
    """Trees as arrays (trees x nodes): a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray    # rows with value <= cut go left
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int32)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[t][at]] <= self.cut[t][at], self.left[t][at], self.right[t][at])
            out += self.value[t][at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.15, least: int = 8, ridge: float = 1.0) -> Flat:
    """Boosted trees for log loss on quantile histograms.  No rows, or labels
    of one class only: the base rate alone."""
    n, width = x.shape
    nodes = 2 ** (depth + 1) - 1
    rate_of = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate_of / (1 - rate_of)))
    empty = lambda kind: np.zeros((max(trees, 1), nodes), dtype=kind)
    flat = Flat(empty(np.int32), empty(float), empty(np.int32), empty(np.int32), empty(float), base, depth)
    flat.left[:] = flat.right[:] = np.arange(nodes)
    if not n or y.min() == y.max():
        return flat
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, dtype=np.int64)
        work = [(0, np.arange(n), 0)]
        while work:
            node, rows, level = work.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            flat.value[t, node] = -rate * g / (h + ridge)
            at[rows] = node
            if level == depth or len(rows) < 2 * least:
                continue
            best = (1e-6, -1, -1)
            for f in range(width):
                b = binned[rows, f]
                gs = np.cumsum(np.bincount(b, grad[rows], BINS))[:-1]
                hs = np.cumsum(np.bincount(b, hess[rows], BINS))[:-1]
                ks = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
                gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                gain[(ks < least) | (len(rows) - ks < least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0] and k < len(cuts[f]):
                    best = (float(gain[k]), f, k)
            if best[1] < 0:
                continue
            _, f, k = best
            low = binned[rows, f] <= k
            a, b = 2 * node + 1, 2 * node + 2
            flat.feature[t, node], flat.cut[t, node], flat.left[t, node], flat.right[t, node] = f, cuts[f][k], a, b
            work += [(a, rows[low], level + 1), (b, rows[~low], level + 1)]
        raw += flat.value[t][at]
    return flat
