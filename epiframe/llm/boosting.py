"""Gradient-boosted trees for two classes, small enough to train on the driver and to ship to workers."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Newton boosting of the logistic loss over binned features; trees of fixed depth, stored as arrays."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.nodes = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            grad, hess = y - q, np.maximum(q * (1 - q), 1e-6)
            feature, cut, value = [np.zeros(1 << (self.depth + 1)) for _ in range(3)]
            feature[:] = -1
            node = np.ones(len(y), np.int64)
            for at in range(1, 1 << self.depth):
                own = np.flatnonzero(node == at)
                split = self._best(binned[own], grad[own], hess[own]) if len(own) else None
                if split is None or split[1] >= len(cuts[split[0]]):
                    continue
                feature[at], cut[at] = split[0], cuts[split[0]][split[1]]
                node[own] = 2 * at + (binned[own, split[0]] > split[1])
            for at in np.unique(node):
                own = node == at
                value[at] = self.rate * grad[own].sum() / (hess[own].sum() + self.ridge)
            f += value[node]
            self.nodes.append((feature.astype(np.int64), cut, value))
        return self

    def _best(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int] | None:
        best, found = 1e-6, None
        g, h = grad.sum(), hess.sum()
        for k in range(b.shape[1]):
            gl = np.cumsum(np.bincount(b[:, k], weights=grad, minlength=self.bins))[:-1]
            hl = np.cumsum(np.bincount(b[:, k], weights=hess, minlength=self.bins))[:-1]
            ok = (hl >= self.least) & (h - hl >= self.least)
            gain = np.where(ok, gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge), 0)
            at = int(np.argmax(gain))
            if gain[at] > best:
                best, found = gain[at], (k, at)
        return found

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Log odds before calibration."""
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.nodes:
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                k = feature[node]
                node = np.where(k >= 0, 2 * node + (x[rows, np.maximum(k, 0)] > cut[node]), node)
            f += value[node]
        return f


def platt(f: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset that turn log odds into calibrated ones, by damped Newton steps with smoothed targets."""
    shift, scale = float(f.mean()), float(f.std()) or 1.0
    g = (f - shift) / scale
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    loss = lambda a, b: float((np.logaddexp(0, a * g + b) - t * (a * g + b)).sum() + 1e-3 * a * a)
    a, b = 1.0, float(np.log(t.mean() / (1 - t.mean())))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * g + b, -30, 30)))
        w, r = np.maximum(p * (1 - p), 1e-9), t - p
        h = np.array([[(w * g * g).sum() + 2e-3, (w * g).sum()], [(w * g).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, [(r * g).sum() - 2e-3 * a, r.sum()])
        size, now = 1.0, loss(a, b)
        while loss(a + size * da, b + size * db) > now and size > 1e-6:
            size /= 2
        a, b = a + size * da, b + size * db
        if size * (abs(da) + abs(db)) < 1e-9:
            break
    return float(a / scale), float(b - a * shift / scale)
