"""Gradient-boosted trees for yes/no labels, on binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of a fixed depth in arrays: node i has children 2i + 1 and 2i + 2; a row goes right if its value exceeds the cut."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, bins: int = 32) -> Boosted:
        """Newton boosting of the logistic loss."""
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
        width = bins + 1
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) + np.arange(f) * width
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        base = float(np.log(share / (1 - share)))
        score, inner = np.full(n, base), 2**depth - 1
        feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first, many = 2**level - 1, 2**level
                place = ((at - first)[:, None] * (f * width) + binned).ravel()
                gs, hs = (np.bincount(place, np.repeat(v, f), many * f * width).reshape(many, f, width) for v in (g, h))
                gl, hl = gs.cumsum(axis=2), hs.cumsum(axis=2)
                gt, ht = gl[:, :, -1:], hl[:, :, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                best = gain.reshape(many, -1).argmax(axis=1)
                for k in range(many):
                    j, b = divmod(int(best[k]), width)
                    if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                        feature[t, first + k], cut[t, first + k] = j, cuts[j][b]
                at = 2 * at + 1 + (x[np.arange(n), feature[t][at]] > cut[t][at])
            at -= inner
            leaf[t] = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
            score += leaf[t][at]
        return cls(base, feature, cut, leaf)
