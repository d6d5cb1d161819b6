"""Gradient-boosted trees for log loss over small feature sets: histogram splits, vectorised, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier. Features are uint8 bins; trees are complete arrays, so that scoring is a few gathers a tree."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, penalty: float = 1.0, bins: int = 16) -> None:
        self.n_trees, self.depth, self.rate, self.penalty, self.bins = trees, depth, rate, penalty, bins

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        """x: rows of bins below self.bins; y: 0 or 1 (or probabilities)."""
        n, f = x.shape
        w = np.ones(n) if weight is None else weight.astype(float)
        self.base = float(np.log((w @ y + 1) / (w @ (1 - y) + 1)))
        score = np.full(n, self.base)
        self.feature, self.cut, self.leaf = [], [], []
        kinds = x.max(axis=0) if n else np.zeros(f, np.uint8)
        two = np.nonzero(kinds == 1)[0]  # binary features: their histograms are one matrix product
        many = np.nonzero(kinds > 1)[0]
        x_two = x[:, two].astype(np.float32)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            g, h = (w * (p - y)).astype(np.float32), (w * np.maximum(p * (1 - p), 1e-6)).astype(np.float32)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, 255, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(2**level):
                    rows = np.nonzero(node == first + k)[0]
                    if len(rows) < 8:
                        continue
                    gr, hr = g[rows], h[rows]
                    gs, hs = float(gr.sum()), float(hr.sum())
                    whole = gs * gs / (hs + self.penalty)
                    best = (1e-4, -1, 0)
                    if len(two):
                        xs = x_two[rows]
                        g1, h1 = gr @ xs, hr @ xs
                        gain = g1**2 / (h1 + self.penalty) + (gs - g1) ** 2 / (hs - h1 + self.penalty) - whole
                        gain[(h1 < 1) | (hs - h1 < 1)] = 0
                        j = int(gain.argmax())
                        best = max(best, (float(gain[j]), int(two[j]), 0))
                    for j in many:
                        b = x[rows, j]
                        gl, hl = np.cumsum(np.bincount(b, gr, self.bins))[:-1], np.cumsum(np.bincount(b, hr, self.bins))[:-1]
                        gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - whole
                        gain[(hl < 1) | (hs - hl < 1)] = 0
                        c = int(gain.argmax())
                        best = max(best, (float(gain[c]), int(j), c))
                    if best[1] >= 0:
                        feature[first + k], cut[first + k] = best[1], best[2]
                at = node - first
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node]) if len(at) else node
            leaves = node - (2**self.depth - 1)
            gsum, hsum = np.bincount(leaves, g, 2**self.depth), np.bincount(leaves, h, 2**self.depth)
            value = -self.rate * gsum / (hsum + self.penalty)
            score += value[leaves]
            self.feature.append(feature), self.cut.append(cut), self.leaf.append(value)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += leaf[node - (2**self.depth - 1)]
        return score


class Logistic:
    """Ridge logistic regression by Newton steps, with Platt scaling of its margin on rows kept aside."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        aside = np.arange(len(y)) % 4 == 3
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._design(x)
        self.w = self._newton(z[~aside], y[~aside], ridge)
        m = np.stack([z[aside] @ self.w, np.ones(int(aside.sum()))], axis=1)
        self.scale = self._newton(m, y[aside], 0.01) if 0 < y[aside].sum() < aside.sum() else np.array([1.0, 0.0])
        return self

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.mean) / self.std, np.ones((len(x), 1))], axis=1)

    @staticmethod
    def _newton(z: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
        w = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def probability(self, x: np.ndarray) -> np.ndarray:
        m = self._design(x) @ self.w
        return 1 / (1 + np.exp(-np.clip(m * self.scale[0] + self.scale[1], -30, 30)))
