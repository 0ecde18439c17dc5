"""Follow-the-regularised-leader updates for sparse linear models with elastic-net penalties."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights of ``outputs`` linear scores over ``size`` features (FTRL-Proximal, per coordinate rates).

    One output is logistic regression, more are multinomial. ``l1`` keeps weights at exactly
    zero until there is evidence for them, ``l2`` shrinks the others.
    """

    def __init__(self, size: int, outputs: int = 1, alpha: float = 0.5, beta: float = 1.0,
                 l1: float = 0.5, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((size, outputs))
        self.n = np.zeros((size, outputs))

    def weights(self, features=slice(None)) -> np.ndarray:
        z, n = self.z[features], self.n[features]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def update(self, features: np.ndarray, values: np.ndarray, label: int) -> None:
        """Learn one example with distinct features."""
        w = self.weights(features)
        p = probabilities(values @ w)
        p[label if len(p) > 1 else 0] -= 1 if len(p) > 1 else label
        gradient = np.outer(values, p)
        n = self.n[features]
        squares = n + gradient * gradient
        self.z[features] += gradient - (np.sqrt(squares) - np.sqrt(n)) / self.alpha * w
        self.n[features] = squares


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Logistic for one score, softmax over the last axis for more."""
    if scores.shape[-1] == 1:
        return 1.0 / (1.0 + np.exp(-np.clip(scores, -60, 60)))
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
