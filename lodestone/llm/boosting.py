"""Gradient-boosted trees on histograms, isotonic calibration and logistic regression, in numpy, for bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Boosted:
    """Trees of fixed depth that fit the gradient of the log loss; features are cut at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 1.0, weight: np.ndarray | None = None):
        weight = np.ones(len(y)) if weight is None else weight
        self.depth = depth
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        binned = self._bin(x)
        share = np.clip((weight * y).sum() / max(weight.sum(), 1e-12), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.base)
        self.trees = []
        for _ in range(trees if len(y) else 0):
            p = sigmoid(raw)
            tree = self._tree(binned, weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), bins, least)
            self.trees.append(tree)
            raw += rate * self._leaf(binned, tree)
        self.rate = rate

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def _tree(self, binned, g, h, bins, least):
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.zeros(nodes, int), np.full(nodes, bins), np.zeros(nodes)
        at = np.zeros(len(g), int)
        for level in range(self.depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.nonzero(at == node)[0]
                total_g, total_h = g[rows].sum(), h[rows].sum()
                best = 1e-6
                for f in range(binned.shape[1]) if len(rows) > 1 else ():
                    b = binned[rows, f]
                    left_g = np.cumsum(np.bincount(b, g[rows], bins))[:-1]
                    left_h = np.cumsum(np.bincount(b, h[rows], bins))[:-1]
                    right_g, right_h = total_g - left_g, total_h - left_h
                    gain = left_g**2 / (left_h + least) + right_g**2 / (right_h + least) - total_g**2 / (total_h + least)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], f, k
                at[rows] = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        for node in range(2**self.depth - 1, nodes):
            rows = at == node
            value[node] = -g[rows].sum() / (h[rows].sum() + least)
        return feature, cut, value

    def _leaf(self, binned, tree):
        feature, cut, value = tree
        at = np.zeros(len(binned), int)
        rows = np.arange(len(binned))
        for _ in range(self.depth):
            at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        binned = self._bin(x)
        return self.base + self.rate * sum((self._leaf(binned, t) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """The nearest rising step function from scores to shares of ones, by pooling; linear between its steps.

    ``prior`` ones and zeros are added to each pool, so that no finite sample gives certainty.
    """

    def __init__(self, score: np.ndarray, y: np.ndarray, prior: float = 0.5):
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []  # sum of ones, rows, sum of scores
        for s, v in zip(score[order], y[order], strict=True):
            pools.append([float(v), 1.0, float(s)])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.x = np.array([p[2] / p[1] for p in pools] or [0.0])
        self.y = np.maximum.accumulate(np.array([(p[0] + prior) / (p[1] + 2 * prior) for p in pools] or [0.0]))

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)


class Logistic:
    """Ridge logistic regression by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, *, ridge: float = 1.0, weight: np.ndarray | None = None, rounds: int = 12):
        x = np.column_stack([np.ones(len(x)), x])
        weight = np.ones(len(y)) if weight is None else weight
        penalty = np.full(x.shape[1], ridge)
        penalty[0] = 1e-3
        self.w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = sigmoid(x @ self.w)
            h = weight * np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((x * h[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.w[0] + x @ self.w[1:]
