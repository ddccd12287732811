"""Small linear models that are fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def sparse_svm(at: np.ndarray, places: np.ndarray, values: np.ndarray, size: int, rows: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Weights (the last one is the bias) of a linear support vector machine, by dual coordinate descent.

    Vector ``i`` has ``values[at[i]:at[i + 1]]`` at the distinct ``places[at[i]:at[i + 1]]`` and 0 elsewhere. ``y`` holds
    -1 and 1 for the vectors ``rows``; classes are weighted by their share.
    """
    spans = list(zip(at[rows].tolist(), at[rows + 1].tolist(), strict=True))
    w, bias, alpha = np.zeros(size, np.float32), 0.0, np.zeros(len(y))
    norm = np.array([float(np.square(values[s:e], dtype=np.float32).sum()) for s, e in spans]) + 1 + 1e-12
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    most = np.array([c * share[int(s)] for s in y])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            s, e = spans[i]
            p, v = places[s:e], values[s:e].astype(np.float32)
            a = min(max(alpha[i] - (y[i] * (float(v @ w[p]) + bias) - 1) / norm[i], 0.0), most[i])
            if a != alpha[i]:
                step = (a - alpha[i]) * y[i]
                w[p] += np.float32(step) * v
                bias += step
                alpha[i] = a
    return np.append(w, np.float32(bias))


def svm(x: np.ndarray, y: np.ndarray, **how) -> np.ndarray:
    """The same for the rows of a matrix."""
    row, place = np.nonzero(x)
    at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))])
    return sparse_svm(at, place, x[row, place], x.shape[1], np.arange(len(x)), y, **how)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (the last one is the bias) of a ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def lasso_logistic(x: np.ndarray, y: np.ndarray, strength: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Sparse weights and bias of an L1-penalised logistic regression, by accelerated proximal gradients."""
    n = max(1, len(x))
    rate = 4 * n / (np.linalg.norm(x, 2) ** 2 + n)
    w = v = np.zeros(x.shape[1])
    b = c = 0.0
    t = 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y
        g = v - rate * (x.T @ e) / n
        new, new_b = np.sign(g) * np.maximum(np.abs(g) - rate * strength, 0), c - rate * e.mean()
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    return w, float(b)
