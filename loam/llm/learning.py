"""Small numpy classifiers that the learning operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Adam:
    """Steps down a gradient, each weight at its own pace."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.05, l2: float = 1e-3) -> np.ndarray:
    """Weights, bias last, of a regularised logistic regression; y may be soft."""
    w, adam = np.zeros(x.shape[1] + 1), Adam(x.shape[1] + 1, rate)
    for _ in range(steps):
        miss = sigmoid(x @ w[:-1] + w[-1]) - y
        w -= adam.step(np.append(x.T @ miss / len(y) + l2 * w[:-1], miss.mean()))
    return w


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
