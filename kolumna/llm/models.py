"""Small numeric models trained on the driver from bounded inputs: isotonic fit, boosted trees, linear SVM."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, edges: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the non-decreasing least-squares fit of y on x: pool adjacent violators.

    n: how often each observation occurred (default: once). Each pooled block gives one knot at its mean score (with
    edges: at its lowest and its highest score); probabilities keep away from 0 and 1 by half an observation.
    Use with np.interp, which interpolates between knots, so that the order of scores survives within blocks' gaps.
    """
    if len(x) == 0:
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, sum of x, lowest x, highest x
    for xi, yi, ni in zip(x[order], y[order], (np.ones(len(x)) if n is None else n)[order]):
        blocks.append([float(ni), float(ni * yi), float(ni * xi), float(xi), float(xi)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, t, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + s, blocks[-1][2] + t, blocks[-1][3], high]
    w, s, t, low, high = np.array(blocks).T
    p = (s + 0.5) / (w + 1.0)
    return (np.stack([low, high], 1).ravel(), np.repeat(p, 2)) if edges else (t / w, p)


def calibrated(raw: np.ndarray, knots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Isotonic probability, with a tiny share of a squashed raw score so that ties keep the raw order."""
    p = np.interp(raw, knots, values)
    return np.clip(p * (1 - 1e-6) + 1e-6 / (1 + np.exp(-np.clip(raw, -50, 50))), 0.0, 1.0)


class BoostedTrees:
    """Logistic gradient boosting of shallow trees over binned features (Newton leaf values)."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 16, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[list[tuple]] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.bias = float(np.log(mean / (1 - mean)))
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T] if len(x) else []
        if not len(y) or y.min() == y.max():
            return self
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1)
        f = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            tree: list[tuple] = []
            f += self.rate * self._grow(binned, g, h, np.arange(len(y)), self.depth, tree, np.zeros(len(y)))
            self.trees.append(tree)
        return self

    def _grow(self, b, g, h, rows, depth, tree, out):
        at = len(tree)
        tree.append(())
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth:
            for j in range(b.shape[1]):
                n = len(self.cuts[j]) + 1
                gs = np.cumsum(np.bincount(b[rows, j], g[rows], n))[:-1]
                hs = np.cumsum(np.bincount(b[rows, j], h[rows], n))[:-1]
                gain = gs**2 / (hs + self.l2) + (total_g - gs) ** 2 / (total_h - hs + self.l2) - total_g**2 / (total_h + self.l2)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            value = total_g / (total_h + self.l2)
            tree[at] = ("leaf", value)
            out[rows] = value
            return out
        _, j, cut = best
        left = b[rows, j] <= cut
        self._grow(b, g, h, rows[left], depth - 1, tree, out)
        right_at = len(tree)
        self._grow(b, g, h, rows[~left], depth - 1, tree, out)
        tree[at] = ("split", j, cut, right_at)
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        if not self.trees or not len(x):
            return f
        b = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1)
        for tree in self.trees:
            stack = [(0, np.arange(len(x)))]
            while stack:
                at, rows = stack.pop()
                node = tree[at]
                if node[0] == "leaf":
                    f[rows] += self.rate * node[1]
                else:
                    left = b[rows, node[1]] <= node[2]
                    stack += [(at + 1, rows[left]), (node[3], rows[~left])]
        return f


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised hinge-loss SVM by dual coordinate descent; y in {-1, 1}; classes balanced."""
    rng = np.random.default_rng(seed)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    cap = c * 0.5 / np.maximum(share, 1e-9)
    norm = (x1**2).sum(1)
    alpha, w = np.zeros(len(x)), np.zeros(x1.shape[1])
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            grad = y[i] * (x1[i] @ w) - 1
            new = min(max(alpha[i] - grad / max(norm[i], 1e-9), 0.0), cap[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x1[i]
                alpha[i] = new
    return w[:-1], float(w[-1])
