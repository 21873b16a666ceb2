"""Bounded samples of labelled rows, and linear models that are fitted on them with numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, rows: int, key: Column) -> DataFrame:
    """At most ``rows`` rows: those with the smallest hash of ``key``, the same ones in every run."""
    return df.withColumn("_by", F.xxhash64(key)).orderBy("_by", key).limit(rows).drop("_by")


class SparseRows:
    """Rows of (column, value) pairs, as one list of entries with borders."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.border = np.concatenate([[0], np.cumsum([len(c) for c in columns])]).astype(np.int64)
        self.column = np.concatenate(columns) if columns else np.empty(0, np.int64)
        self.value = np.concatenate(values) if values else np.ones(len(self.column), np.float32)
        self.row = np.repeat(np.arange(len(columns)), np.diff(self.border))

    def __len__(self) -> int:
        return len(self.border) - 1

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.column], minlength=len(self))

    def gradient(self, errors: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.column, self.value * errors[self.row], minlength=size)


def fit_logistic(x: SparseRows, target: np.ndarray, size: int, ridge: float = 1e-4, steps: int = 300, weight=None):
    """(weights, bias) by full gradients with AdaGrad steps; targets may lie between 0 and 1."""
    w, b = np.zeros(size), 0.0
    weight = np.ones(len(x)) if weight is None else weight
    weight = weight / weight.sum()
    seen, seen_b = np.full(size, 1e-12), 1e-12
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(x.times(w) + b, -30, 30))) - target)
        g, gb = x.gradient(error, size) + ridge * w, error.sum()
        seen += g * g
        seen_b += gb * gb
        w -= 1.0 * g / np.sqrt(seen)
        b -= 1.0 * gb / np.sqrt(seen_b)
    return w, b


class PackedRows:
    """Rows of bytes, read as float rows of length one; a quarter of the memory, and parts copy nothing."""

    def __init__(self, data: np.ndarray, index: np.ndarray | None = None):
        self.data = data
        self.index = np.arange(len(data)) if index is None else index

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.index), self.data.shape[1]

    def part(self, chosen) -> PackedRows:
        return PackedRows(self.data, self.index[np.asarray(chosen)])

    def __getitem__(self, chosen) -> np.ndarray:
        rows = self.data[self.index[chosen]].astype(np.float32)
        rows /= np.maximum(1e-9, np.sqrt((rows * rows).sum(1, keepdims=True)))
        return rows


def fit_svm(x: np.ndarray | PackedRows, sign: np.ndarray, ridge: float = 1e-4, epochs: int = 30, seed: int = 0):
    """(weights, bias) of a linear support vector machine on dense rows, by averaged Pegasos steps in small batches.

    Both classes count alike, however many rows each has.
    """
    rng = np.random.default_rng(seed)
    n, d = x.shape
    balance = np.where(sign > 0, n / (2 * max(1, (sign > 0).sum())), n / (2 * max(1, (sign < 0).sum())))
    w, b, total, total_b, step = np.zeros(d), 0.0, np.zeros(d), 0.0, 0
    batch = 64
    for epoch in range(epochs):
        for chosen in np.array_split(rng.permutation(n), max(1, n // batch)):
            step += 1
            rate = 1 / (ridge * (step + 1000))
            rows = x[chosen]
            margin = sign[chosen] * (rows @ w + b)
            active = (margin < 1) * sign[chosen] * balance[chosen] / len(chosen)
            w = (1 - rate * ridge) * w + rate * (active @ rows)
            b += rate * 0.01 * active.sum()
            if epoch >= epochs // 2:
                total += w
                total_b += b
    seen = max(1, sum(max(1, n // batch) for e in range(epochs) if e >= epochs // 2))
    return total / seen, total_b / seen
