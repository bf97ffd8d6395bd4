"""Sparse logistic regression on the driver, for bounded samples of labelled rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Binary features: row i has columns[bounds[i]:bounds[i + 1]]."""

    columns: np.ndarray
    bounds: np.ndarray

    def dot(self, weights: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0.0], np.cumsum(weights[self.columns])])
        return upto[self.bounds[1:]] - upto[self.bounds[:-1]]

    def pull(self, per_row: np.ndarray, n: int) -> np.ndarray:
        """The transpose: for each column the sum over its rows."""
        return np.bincount(self.columns, np.repeat(per_row, np.diff(self.bounds)), n)

    def take(self, rows: np.ndarray) -> Rows:
        sizes = np.diff(self.bounds)[rows]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.bounds[:-1][rows] - upto[:-1], sizes) + np.arange(upto[-1])
        return Rows(self.columns[at], upto)


def rows_of(lists: list[np.ndarray]) -> Rows:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return Rows(np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64), bounds)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: Rows, y: np.ndarray, n: int, l1: float = 0.0, l2: float = 1e-4, steps: int = 200, pairs: tuple[Rows, Rows] | None = None, pair_weight: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias, by accelerated proximal gradient (deterministic).

    ``pairs``: rows and their counterfactuals; the mean squared difference of
    their scores is penalised with ``pair_weight``.
    """
    m = max(len(y), 1)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(n), float(np.log(share / (1 - share)))
    # columns are scaled to a common curvature, else rare words hardly move
    count = np.bincount(x.columns, minlength=n)
    scale = 1 / np.sqrt(np.maximum(count, 1) / m)
    w = z = np.zeros(n)
    b = zb = float(np.log(y.mean() / (1 - y.mean())))
    def curved(v: np.ndarray) -> np.ndarray:
        """The loss's curvature, bounded above, in direction ``v``."""
        out = 0.25 * scale * x.pull(x.dot(scale * v), n) / m
        if pairs and len(pairs[0].bounds) > 1:
            diff = pairs[0].dot(scale * v) - pairs[1].dot(scale * v)
            out += 2 * pair_weight * scale * (pairs[0].pull(diff, n) - pairs[1].pull(diff, n)) / len(diff)
        return out

    v, size = np.ones(n), 1.0
    for _ in range(30):  # the largest curvature, by power iteration
        v = curved(v / (np.linalg.norm(v) or 1.0))
        size = np.linalg.norm(v)
    step, t = 1 / (1.1 * size + 0.25 + l2), 1.0
    for _ in range(steps):
        err = sigmoid(x.dot(scale * z) + zb) - y
        grad = scale * x.pull(err, n) / m + l2 * z
        if pairs and len(pairs[0].bounds) > 1:
            diff = pairs[0].dot(scale * z) - pairs[1].dot(scale * z)
            grad += 2 * pair_weight * scale * (pairs[0].pull(diff, n) - pairs[1].pull(diff, n)) / len(diff)
        new = z - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        newb = zb - 4 * step * err.mean()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / after * (new - w), newb + (t - 1) / after * (newb - b)
        w, b, t = new, newb, after
    return scale * w, float(b)


def calibrate(score: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities (Newton's method, smoothed targets)."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * score + b)
        g = np.array([((p - t) * score).sum() + 1e-3 * (a - 1), (p - t).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * score * score).sum() + 1e-3, (q * score).sum()], [(q * score).sum(), q.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        size = np.abs(d).max()
        a, b = a - d[0] * min(1, 2 / size) if size else a, b - d[1] * min(1, 2 / size) if size else b
    return float(a), float(b)


def stacked(scores: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 100) -> tuple[np.ndarray, float]:
    """Slopes of several scores (columns), none below 0, and an offset: logistic regression by Newton's method.

    A score whose slope comes out below 0 is left out.
    """
    used = np.arange(scores.shape[1])
    while True:
        x = np.column_stack([scores[:, used], np.ones(len(y))])
        w, keep = np.zeros(len(used) + 1), np.append(np.full(len(used), ridge), 1e-6)
        for _ in range(steps):
            p = sigmoid(x @ w)
            d = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
            w = w - d * min(1.0, 2 / max(np.abs(d).max(), 1e-12))
        if not len(used) or w[:-1].min() >= 0:
            break
        used = used[w[:-1] > 0]
    slopes = np.zeros(scores.shape[1])
    slopes[used] = w[:-1]
    return slopes, float(w[-1])
