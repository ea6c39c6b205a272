"""Logistic regression on a bounded sample, for the driver: sparse rows in, weights and a calibration out."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 300, pairs: np.ndarray | None = None, penalty: float = 0.0, balance: bool = True) -> tuple[np.ndarray, float]:
    """Weights and bias by Nesterov's accelerated gradient on the mean log loss.

    balance: both classes weigh the same.  pairs: for each row the features of its changed copy; ``penalty`` times the
    mean squared difference of the two scores (before the sigmoid) is added to the loss.
    """
    n, d = x.shape
    weight = np.ones(n)
    if balance and 0 < y.sum() < n:
        weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    weight = weight / weight.sum()
    diff = None if pairs is None else x - pairs
    norm = float((weight * np.einsum("ij,ij->i", x, x)).sum()) if n else 1.0
    rate = 1.0 / (0.25 * (norm + 1) + l2 + (2 * penalty * float(np.einsum("ij,ij->i", diff, diff).mean()) if diff is not None else 0.0))
    x, weight = x.astype(np.float32, copy=False), weight.astype(np.float32)
    w, b = np.zeros(d, np.float32), 0.0
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps if n else 0):
        g = weight * (sigmoid(x @ vw + vb) - y)
        gw, gb = x.T @ g + l2 * vw, g.sum()
        if diff is not None:
            gw = gw + 2 * penalty * (diff.T @ (diff @ vw)) / n
        nw, nb = vw - rate * gw, vb - rate * gb
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return w, float(b)


def platt(score: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and intercept that turn scores into probabilities (Newton steps on the log loss with smoothed targets)."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * score + b)
        g = np.array([((p - target) * score).sum(), (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * score * score).sum() + 1e-6, (s * score).sum()], [(s * score).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)
