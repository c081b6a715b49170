"""Huber regression on random Fourier features of the Gaussian kernel.

The problem is that of a linear model with Huber's loss and a scale estimated
beside it, of label ``y`` and mapped row ``z``: least over ``w, b, s > 0`` of::

    sum(0.5 * (s + s * H((y - w.z - b) / s))) + 0.5 * n * reg * |deviation * w|^2

``H(t)`` is ``t^2`` up to ``EPSILON`` and ``2 * EPSILON * |t| - EPSILON^2``
beyond. It is convex in all three, and solved by Newton's steps: one pass over
the rows adds up loss, gradient and curvature at a point, and a second one, only
where the full step does not help, the loss after shorter steps. Vectors are
packed once; rows are mapped anew in each pass, and mapped ones are stored nowhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.kernels import dense, packed, summed
from ledgerloom.session import Rounds

EPSILON = 1.35  # residuals in units of the scale up to which the loss is a square
DONE = 1e-10  # expected gain of a step, as a share of the objective, at which the fit ends
_LENGTHS = 0.5 ** np.arange(1, 31)


def fourier_map(width: int, gamma: float, size: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """Random features whose products approach exp(-gamma * distance squared)."""
    rng = np.random.default_rng(seed)
    directions = rng.normal(0.0, math.sqrt(2.0 * gamma), (width, size))
    phases = rng.uniform(0.0, 2.0 * math.pi, size)
    return lambda x: math.sqrt(2.0 / size) * np.cos(x @ directions + phases)


def _loss(left: np.ndarray, scale: np.ndarray) -> np.ndarray:
    far = np.abs(left)
    flat = EPSILON * far - 0.5 * EPSILON * EPSILON * scale
    return 0.5 * scale + np.where(far <= EPSILON * scale, 0.5 * left * left / scale, flat)


def _curved(mapped, point: np.ndarray):
    """Per block: curvature and gradient by (weights, intercept, scale), then the loss."""
    scale = point[-1]

    def work(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.column_stack([mapped(x), np.ones(len(x))])
        left = y - z @ point[:-1]
        inside = np.abs(left) <= EPSILON * scale
        near = np.column_stack([z[inside], left[inside] / scale])
        told = np.zeros((len(point) + 2, len(point)))
        told[: len(point)] = near.T @ near / scale
        told[-2, :-1] = -np.clip(left / scale, -EPSILON, EPSILON) @ z
        told[-2, -1] = 0.5 * (1.0 - np.minimum(np.abs(left) / scale, EPSILON) ** 2).sum()
        told[-1, 0] = _loss(left, scale).sum()
        return told

    return work


def _lossy(mapped, tried: np.ndarray):
    """Per block: the loss at each column of ``tried``."""

    def work(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        left = y[:, None] - mapped(x) @ tried[:-2] - tried[-2]
        return _loss(left, tried[-1]).sum(axis=0)[None, :]

    return work


def _moments(mapped, size: int):
    def work(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.column_stack([mapped(x), y])
        return np.vstack([z.sum(axis=0), (z * z).sum(axis=0), np.full(size + 1, len(y))])

    return work


def fit_huber(train: DataFrame, width: int, gamma: float, size: int, seed: int, reg: float, steps: int) -> "FourierModel":
    """Fit on ``features`` of ``width`` entries and ``label``; ``reg`` is the penalty beside the mean loss."""
    written = Rounds()
    try:
        return _solved(written.write(packed(train, width)), width, gamma, size, seed, reg, steps)
    finally:
        written.close(train.sparkSession)


def _solved(blocks: DataFrame, width: int, gamma: float, size: int, seed: int, reg: float, steps: int) -> "FourierModel":
    mapped = fourier_map(width, gamma, size, seed)
    first, second, count = summed(blocks, width, _moments(mapped, size), 3)
    n = count[0]
    spread = np.maximum(second - first * first / n, 0.0)
    if spread[-1] <= 1e-18 * second[-1]:  # labels all alike: no scale
        return FourierModel(np.zeros(size), float(first[-1] / n), width, gamma, seed)
    penalty = np.append(n * reg * spread[:-1] / max(n - 1, 1), [0.0, 0.0])
    point = np.append(np.zeros(size), [first[-1] / n, math.sqrt(spread[-1] / n)])

    def at(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = summed(blocks, width, _curved(mapped, point), size + 4)
        return float(sums[-1, 0] + 0.5 * penalty @ (point * point)), sums[-2] + penalty * point, sums[: size + 2] + np.diag(penalty)

    objective, gradient, curvature = at(point)
    for _ in range(steps):
        top = max(float(curvature.diagonal().max()), 1e-300)
        step = np.linalg.solve(curvature + 1e-12 * top * np.eye(size + 2), gradient)
        gain = float(gradient @ step)
        if gain <= DONE * max(abs(objective), 1e-300):
            return FourierModel(point[:size], float(point[size]), width, gamma, seed)
        ahead = point - step
        told = at(ahead) if ahead[-1] > 0 else None
        if told is None or not told[0] <= objective - 1e-4 * gain:
            tried = np.column_stack([point - length * step for length in _LENGTHS])
            tried = tried[:, tried[-1] > 0]
            values = summed(blocks, width, _lossy(mapped, tried), 1)[0] + 0.5 * penalty @ (tried * tried)
            least = int(np.argmin(values))
            if not values[least] < objective:  # below what sums of doubles resolve
                return FourierModel(point[:size], float(point[size]), width, gamma, seed)
            ahead = tried[:, least]
            told = at(ahead)
        point, (objective, gradient, curvature) = ahead, told
    raise RuntimeError(f"no convergence within {steps} iterations")


class FourierModel:
    """A robust linear model on random Fourier features of the vectors."""

    kind = "fourier"

    def __init__(self, weights: np.ndarray, intercept: float, width: int, gamma: float, seed: int):
        self.weights, self.intercept, self.width, self.gamma, self.seed = weights, intercept, width, gamma, seed

    def predict(self, df: DataFrame) -> DataFrame:
        weights, intercept, width = self.weights, self.intercept, self.width
        mapped = fourier_map(width, self.gamma, len(weights), self.seed)

        def answer(rows: pa.Array) -> pa.Array:
            return pa.array(mapped(dense(rows, width)) @ weights + intercept)

        return df.withColumn("prediction", F.arrow_udf(answer, "double")(F.unwrap_udt("features"))).select(*df.columns, "prediction")

    def save(self, path: str, spark: SparkSession) -> dict:
        rows = [(i, float(v)) for i, v in enumerate(self.weights)]
        spark.createDataFrame(rows, "i int, weight double").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
        return {"intercept": self.intercept, "width": self.width, "gamma": self.gamma, "seed": self.seed}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> "FourierModel":
        rows = spark.read.parquet(f"{path}/weights").orderBy("i").collect()
        return cls(np.array([r["weight"] for r in rows], float), **meta)
