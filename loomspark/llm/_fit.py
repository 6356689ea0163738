"""Small dense and sparse logistic fits in numpy, for bounded samples on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, *, l2: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression, by Newton steps; one class alone gives its constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2 * max(len(x), 1))
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log odds."""
    return x @ w[:-1] + w[-1]


def auc(y: np.ndarray, s: np.ndarray) -> float:
    """Chance that a positive scores above a negative; ties count half."""
    y = np.asarray(y, bool)
    if y.all() or not y.any():
        return float("nan")
    kinds, back, counts = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[back]
    p, n = y.sum(), (~y).sum()
    return float((rank[y].sum() - p * (p + 1) / 2) / (p * n))
