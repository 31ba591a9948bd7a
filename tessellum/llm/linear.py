"""A small logistic regression for the driver: fitted on bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def sparse_dot(offsets: np.ndarray, index: np.ndarray, value: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Row sums of value * w[index] for rows offsets[i]:offsets[i + 1]."""
    total = np.append(0, np.cumsum(value * w[index]))
    return total[offsets[1:]] - total[offsets[:-1]]


def objective(rows: tuple, y: np.ndarray, w: np.ndarray, b: float, ridge: float, pairs: tuple | None = None, tie: float = 0.0) -> float:
    """The loss that ``fit_sparse`` descends: mean log loss, ridge, and tie times the mean squared gap of the pairs."""
    z = sparse_dot(*rows, w) + b
    loss = np.mean(np.logaddexp(0, z) - y * z) + ridge * (w @ w) / (2 * max(len(y), 1))
    return float(loss + (tie * np.mean(sparse_dot(*pairs, w) ** 2) if pairs is not None and len(pairs[0]) > 1 else 0.0))


def slope(rows: tuple, y: np.ndarray, w: np.ndarray, b: float, ridge: float, pairs: tuple | None = None, tie: float = 0.0) -> tuple[np.ndarray, float]:
    """Its gradient."""
    offsets, index, value = rows
    n = max(len(y), 1)
    miss = (sigmoid(sparse_dot(offsets, index, value, w) + b) - y) / n
    g = np.bincount(index, value * np.repeat(miss, np.diff(offsets)), len(w)) + ridge * w / n
    if pairs is not None and len(pairs[0]) > 1 and tie:
        po, pi, pv = pairs
        gap = sparse_dot(po, pi, pv, w)
        g += 2 * tie / len(gap) * np.bincount(pi, pv * np.repeat(gap, np.diff(po)), len(w))
    return g, float(miss.sum())


def fit_sparse(rows: tuple, y: np.ndarray, n_features: int, ridge: float, pairs: tuple | None = None, tie: float = 0.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Gradient descent with momentum and diagonal scaling.

    rows: (offsets, index, value).  pairs: the differences of the features of
    sentences and their swapped versions, in the same form; ``tie`` times the
    mean squared difference of their scores is added to the loss.
    """
    w, b = np.zeros(n_features), 0.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb = slope(rows, y, w, b, ridge, pairs, tie)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * (1 - t / (steps + 1))
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b
