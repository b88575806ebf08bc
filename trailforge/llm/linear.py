"""Logistic regression on sparse features and Platt calibration, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_sparse(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, epochs: int = 6, rate: float = 0.5, l2: float = 1e-5, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by Adagrad over rows (indices, values)."""
    w, g2 = np.zeros(dim), np.full(dim, 1e-6)
    bias, bias2 = 0.0, 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x = rows[k]
            err = sigmoid(w[at] @ x + bias) - y[k]
            grad = err * x + l2 * w[at]
            g2[at] += grad * grad
            w[at] -= rate * grad / np.sqrt(g2[at])
            bias2 += err * err
            bias -= rate * err / np.sqrt(bias2)
    return w, bias


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (the last one the bias) of a logistic regression on a few columns, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * l2
    ridge[-1, -1] = 1e-9
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) / len(y) + ridge @ w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge
        move = np.linalg.solve(hess + 1e-9 * np.eye(len(w)), grad)
        move *= min(1.0, 5.0 / max(1e-12, np.abs(move).max()))
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make a margin a probability (targets smoothed as Platt did)."""
    pos, neg = y.sum(), len(y) - y.sum()
    soft = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = fit_dense(margin[:, None], soft, l2=1e-6)
    return float(a), float(b)
