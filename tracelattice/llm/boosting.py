"""Gradient-boosted trees for two classes on binned features, in numpy, with calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of fixed depth: split feature and bin per inner node, value per leaf; and the calibration."""

    edges: list[np.ndarray]
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    split: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for f, s, v in zip(self.feature, self.split, self.value):
            node = np.zeros(len(b), np.int64)
            while node.size and node[0] < len(f):
                node = 2 * node + 1 + (b[np.arange(len(b)), f[node]] > s[node])
            out += v[node - len(f)] if node.size else 0
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; each tree splits level by level on the best binned feature."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1], method="lower")) for j in range(x.shape[1])]
    rate0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(rate0 / (1 - rate0))))
    b, margin = model.binned(x), np.full(len(x), model.base)
    d = x.shape[1]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        inner = 2**depth - 1
        feature, split, node = np.zeros(inner, np.int64), np.full(inner, bins + 1), np.zeros(len(x), np.int64)
        for level in range(depth):
            low, n = 2**level - 1, 2**level
            best = np.zeros(n)
            for j in range(d):
                cell = (node - low) * (bins + 1) + b[:, j]
                gs = np.bincount(cell, g, n * (bins + 1)).reshape(n, -1).cumsum(1)
                hs = np.bincount(cell, h, n * (bins + 1)).reshape(n, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                at = gain[:, :-1].argmax(1)
                top = gain[np.arange(n), at]
                for k in np.flatnonzero(top > best + 1e-9):
                    best[k], feature[low + k], split[low + k] = top[k], j, at[k]
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > split[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        model.feature.append(feature)
        model.split.append(split)
        model.value.append(value)
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, steps: int = 50) -> None:
    """Fit slope and shift of the margin on held-out rows (Newton steps, slightly ridged)."""
    z = np.stack([model.margin(x), np.ones(len(x))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 0.1 * (w - [1.0, 0.0])
        hess = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    model.slope, model.shift = float(w[0]), float(w[1])


def precise_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The smallest probability at and above which the share of positives is at least `precision`; over 1 if none."""
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    last = np.append(np.diff(p[order]) != 0, True)
    good = np.flatnonzero((share >= precision) & last)
    return float(p[order][good[-1]]) if len(good) and y.any() else 2.0
