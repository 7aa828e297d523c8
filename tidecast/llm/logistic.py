"""Logistic regression on a few features, of a bounded sample or of a table of any length."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the constant first

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[0] + (x - self.mean) / self.scale @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
    """Newton steps; with rows of one label only, or none, the share of ones (smoothed) is all there is."""
    if not len(y):
        return Logistic(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(a.shape[1])
    w[0] = np.log(share / (1 - share))
    if y.min() == y.max():
        return Logistic(mean, scale, w)
    penalty = np.diag([1e-6] + [ridge] * (a.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w)


def fit_table(rows: DataFrame, width: int, ridge: float = 1.0, steps: int = 30) -> Logistic:
    """Like ``fit``, for a written table of ``_label`` and ``_x``; each step is one pass, summed by task."""
    def total(of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = 0.0
            for batch in batches:
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                held = held + of(x, batch.column("_label").to_numpy(zero_copy_only=False).astype(float)).ravel()
            if np.ndim(held):
                yield pa.RecordBatch.from_arrays([pa.array([held.tolist()], pa.list_(pa.float64()))], names=["v"])
        return np.sum([r["v"] for r in rows.select("_label", "_x").mapInArrow(run, "v array<double>").collect()], axis=0)

    n, least, most, ones = rows.agg(F.count("*"), F.min("_label"), F.max("_label"), F.sum("_label")).first()
    if not n:
        return Logistic(np.zeros(width), np.ones(width), np.zeros(width + 1))
    mean = total(lambda x, y: x.sum(0)) / n
    scale = np.maximum(np.sqrt(total(lambda x, y: ((x - mean) ** 2).sum(0)) / n), 1e-9)
    share = (ones + 0.5) / (n + 1)
    w = np.zeros(width + 1)
    w[0] = np.log(share / (1 - share))
    if least == most:
        return Logistic(mean, scale, w)
    penalty = np.diag([1e-6] + [ridge] * width)
    for _ in range(steps):
        def curvature(x: np.ndarray, y: np.ndarray, w=w) -> np.ndarray:
            a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            return np.vstack([(a * (p * (1 - p) + 1e-9)[:, None]).T @ a, a.T @ (y - p)])

        sums = total(curvature).reshape(width + 2, width + 1)
        step = np.linalg.solve(sums[:-1] + penalty, sums[-1] - penalty @ w)
        w = w + step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w)
