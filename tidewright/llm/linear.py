"""Follow-the-regularised-leader learning of linear classifiers on hashed sparse features (FTRL-proximal)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Ftrl:
    """Softmax regression with a learning rate per coordinate, L1 (sparsity) and L2.

    Weights are never stored while learning: they follow from the sums z (of gradients, adjusted) and n (of squares).
    """

    dims: int
    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0

    def __post_init__(self):
        self.z = np.zeros((self.dims + 1, self.classes))  # the last row is the bias
        self.n = np.zeros((self.dims + 1, self.classes))

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        """One example: distinct feature numbers, their values, the class."""
        index, value = np.append(index, self.dims), np.append(value, 1.0)
        z, n = self.z[index], self.n[index]
        w = self._weights(z, n)
        error = softmax(value @ w)
        error[label] -= 1.0
        g = value[:, None] * error[None, :]
        after = n + g * g
        self.z[index] = z + g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[index] = after

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n).astype(np.float32)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores under which the labels are likeliest (golden-section search on its logarithm).

    One more text is taken to have any of the labels: where all texts are told apart, scores would else become certain.
    """
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        logs = np.log(np.maximum(softmax(scores / np.exp(log_t)), 1e-30))
        return -float((1 - spread) * logs[np.arange(len(labels)), labels].mean() + spread * logs.mean())

    spread = 1 / (len(labels) + 1)
    low, high, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    import io

    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    import io

    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}
