"""Follow-the-regularised-leader (proximal, per coordinate) for logistic and multinomial models on sparse rows.

Rows are given as (indices, values); weights stay at zero until a coordinate's summed gradient passes the L1 penalty.
"""

from __future__ import annotations

import numpy as np


class Ftrl:
    def __init__(self, size: int, classes: int = 1, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((size, classes))
        self.n = np.zeros((size, classes))

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, index: np.ndarray, value: np.ndarray, target: np.ndarray) -> np.ndarray:
        """One row; target: 0/1 for one class, else one-hot. Returns the prediction made before the update."""
        w = self.weights(index)
        score = value @ w
        if len(score) == 1:
            p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        else:
            p = np.exp(score - score.max())
            p /= p.sum()
        g = value[:, None] * (p - target)[None, :]
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g
        return p


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature under which softmax(logits / t) gives truth the greatest likelihood, by golden-section search."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(truth)), truth]))

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
