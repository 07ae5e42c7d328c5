"""Fitting classifiers on a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled rows a classifier is fitted on, at most; fewer are all used. Two numbers each, so
# that their table may be broadcast.
MAX_LABELLED = 200_000


def label_sample(
    labels: DataFrame, id_column: str, label_column: str, limit: int = MAX_LABELLED
) -> DataFrame:
    """``label_id, label``: 0 or 1 for at most ``limit`` ids, chosen by hash.

    Rows without id or label are left out; of differing labels of an id the larger counts.
    """
    known = labels.select(
        F.col(id_column).alias("label_id"), F.col(label_column).cast("int").alias("label")
    ).filter("label_id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("label_id").agg(F.max("label").alias("label"))
    total = known.count()
    share = 1.0
    while total > limit:
        share *= 0.95 * limit / total
        cut = int(share * (1 << 30))
        known = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < cut)
        total = known.count()
    return known


def logistic(
    features: np.ndarray, ones: np.ndarray, zeros: np.ndarray, penalty: float, rounds: int = 50
) -> np.ndarray:
    """Weights, the intercept first, of a ridge logistic regression by Newton's method.

    Rows of ``features`` may stand for several examples: ``ones`` and ``zeros`` count them.
    """
    x = np.concatenate([np.ones((len(features), 1)), features], axis=1)
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    total = ones + zeros
    weights = np.zeros(x.shape[1])
    if total.sum():
        weights[0] = np.log((ones.sum() + 0.5) / (zeros.sum() + 0.5))
    for _ in range(rounds):
        p = sigmoid(x @ weights)
        slope = x.T @ (ones - total * p) - ridge * weights
        curve = (x * (total * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        # Steps are bounded, so that separable data cannot throw the iteration off.
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        weights += step
        if np.abs(step).max() < 1e-7:
            break
    return weights


def sparse_logistic(
    present: list[list[int]],
    features: int,
    ones: np.ndarray,
    zeros: np.ndarray,
    penalty: float,
    rounds: int = 50,
) -> np.ndarray:
    """Weights as of ``logistic`` for rows given by the features they have, of any number.

    Newton's steps are solved by conjugate gradients, which need no matrix.
    """
    row = np.repeat(np.arange(len(present)), [len(columns) for columns in present])
    column = np.array([c + 1 for columns in present for c in columns], dtype=np.int64)

    def times(w: np.ndarray) -> np.ndarray:
        return w[0] + np.bincount(row, w[column], len(present))

    def back(v: np.ndarray) -> np.ndarray:
        # Without any feature present the counts would be integers.
        found = np.bincount(column, v[row], features + 1).astype(float)
        found[0] = v.sum()
        return found

    ridge = np.full(features + 1, penalty)
    ridge[0] = 1e-3
    total = ones + zeros
    weights = np.zeros(features + 1)
    if total.sum():
        weights[0] = np.log((ones.sum() + 0.5) / (zeros.sum() + 0.5))
    for _ in range(rounds):
        p = sigmoid(times(weights))
        spread = total * p * (1 - p)
        slope = back(ones - total * p) - ridge * weights
        step = _conjugate_gradients(
            lambda w, spread=spread: back(spread * times(w)) + ridge * w, slope
        )
        # Steps are bounded, so that separable data cannot throw the iteration off.
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        weights += step
        if np.abs(step).max() < 1e-7:
            break
    return weights


def _conjugate_gradients(curve, slope: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """The solution of ``curve(x) = slope`` for a positive definite ``curve``."""
    x, residual, way = np.zeros_like(slope), slope.copy(), slope.copy()
    size = residual @ residual
    goal = size * 1e-20
    for _ in range(rounds):
        if size <= goal or size == 0:
            break
        bent = curve(way)
        length = size / (way @ bent)
        x += length * way
        residual -= length * bent
        size, before = residual @ residual, size
        way = residual + size / before * way
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
