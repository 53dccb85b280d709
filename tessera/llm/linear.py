"""Hashed word n-grams and logistic regression trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np

#: Runs of letters and digits, or of marks: so a mark that is glued to many words is one feature.
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0D]+")


#: Stands for a word that follows itself, whatever word it is.
REPEAT = np.uint32(0x52455054)


def features(text: bytes, bits: int, n_grams: int = 2) -> np.ndarray:
    """The hash, of so many bits, of every word and word pair of a text, repeats included."""
    one = np.array([crc32(w) for w in TOKEN.findall(text)], np.uint32)
    grams, last = [one], one
    for n in range(1, n_grams):
        if len(one) <= n:
            break
        last = last[:-1] * np.uint32(0x9E3779B1) ^ one[n:]
        grams.append(last)
    grams.append(np.full(np.count_nonzero(one[1:] == one[:-1]), REPEAT))
    mixed = np.concatenate(grams)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (mixed >> np.uint32(32 - bits)).astype(np.int32)


class Ftrl:
    """Logistic regression over sparse rows; weights at 0 until a coordinate's gradients outweigh l1.

    A row is its features' hashes, each worth 1 / sqrt(number of features), then `extra` dense
    inputs, then a constant 1.
    """

    def __init__(self, bits: int, extra: int = 0, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.2, l2: float = 0.5):
        self.bits, self.extra = bits, extra
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + extra + 1)
        self.n = np.zeros_like(self.z)

    def _row(self, ids: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, times = np.unique(ids, return_counts=True)
        tail = (1 << self.bits) + np.arange(self.extra + 1)
        return np.concatenate((at, tail)), np.concatenate((times / np.sqrt(max(1, len(ids))), dense, [1.0]))

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, ids: np.ndarray, label: float, dense: np.ndarray = np.zeros(0)) -> None:
        at, x = self._row(ids, dense)
        z, n = self.z[at], self.n[at]
        w = self._weights(z, n)
        g = (sigmoid(w @ x) - label) * x
        more = n + g * g
        self.z[at] = z + g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more

    @property
    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n).astype(np.float32)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def margin(weights: np.ndarray, bits: int, ids: np.ndarray, dense: np.ndarray = np.zeros(0)) -> float:
    """The sparse dot product of a row with the weights."""
    tail = weights[1 << bits :].astype(np.float64)
    return float(weights[ids].sum(dtype=np.float64) / np.sqrt(max(1, len(ids))) + tail[: len(dense)] @ dense + tail[-1])


def trained(rows: list[tuple], bits: int, epochs: int, **how: float) -> np.ndarray:
    """The weights after so many passes over (features, label), or (features, label, dense inputs), in the given order."""
    width = len(rows[0][2]) if rows and len(rows[0]) > 2 else 0
    model = Ftrl(bits, width, **how)
    for _ in range(epochs):
        for row in rows:
            model.update(*row)
    return model.weights
