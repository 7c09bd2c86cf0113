"""Linear models on sparse rows, trained with follow-the-regularised-leader and elastic-net penalties."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Row = tuple[np.ndarray, np.ndarray]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass(frozen=True)
class Penalty:
    """Learning rate ``alpha / (beta + root of squared gradients)``, l1 and l2."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.1


class Leader:
    """Weights of shape (features + 1, outputs); the last row is the bias, which has no penalty."""

    def __init__(self, features: int, outputs: int, penalty: Penalty):
        self.p = penalty
        self.z = np.zeros((features + 1, outputs))
        self.n = np.zeros((features + 1, outputs))

    def weights_at(self, at: np.ndarray) -> np.ndarray:
        p, z = self.p, self.z[at]
        w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2)
        return np.where(np.abs(z) <= p.l1, 0.0, w)

    def bias(self) -> np.ndarray:
        return -self.z[-1] / ((self.p.beta + np.sqrt(self.n[-1])) / self.p.alpha)

    def weights(self) -> np.ndarray:
        return np.vstack((self.weights_at(np.arange(len(self.z) - 1)), self.bias()))

    def learn(self, row: Row, target: np.ndarray, many: bool) -> None:
        """One step; ``many`` outputs share a softmax, others have a sigmoid each."""
        at, x = row
        w, b = self.weights_at(at), self.bias()
        z = x @ w + b
        error = (softmax(z) if many else sigmoid(z)) - target
        for where, old, g in ((at, w, x[:, None] * error), (-1, b, error)):
            n = self.n[where]
            self.z[where] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * old
            self.n[where] = n + g * g


def fit(rows: list[Row], targets: np.ndarray, features: int, penalty: Penalty, epochs: int, many: bool, seed: int = 0) -> np.ndarray:
    """Weights after some passes in random order."""
    leader, rng = Leader(features, targets.shape[1], penalty), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            leader.learn(rows[i], targets[i], many)
    return leader.weights()


def scores(rows: list[Row], weights: np.ndarray) -> np.ndarray:
    return np.array([x @ weights[at] + weights[-1] for at, x in rows]).reshape(len(rows), weights.shape[1])


def temperature(z: np.ndarray, target: np.ndarray) -> float:
    """What the scores are best divided by: golden-section search for the least log loss."""

    def loss(t: float) -> float:
        return -float(np.log(np.maximum((softmax(z / np.exp(t)) * target).sum(1), 1e-300)).mean())

    if not len(z):
        return 1.0
    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
