"""Kernel regression with the epsilon-insensitive loss on landmark features.

The problem is the support vector machine's: with the Gaussian kernel
``exp(-gamma * distance squared)``, least of::

    0.5 * |w|^2 + C * sum(max(0, |label - w.phi(x) - b| - EPSILON))

``phi`` is the Nystroem map over ``landmarks`` distinct rows, those of the least
hash, so the kernel is exact where the table has no more distinct rows, and the
answer does not depend on partitioning. Each step is one pass over the rows that
adds up loss, gradient and curvature of landmark size after the full step and,
only where that does not help, a second one for the loss after steps of several
lengths and dampings at once; only these sums and the landmarks reach the driver. Vectors are packed once, some thousand to a
record, without their zeros. Rows are mapped anew in each pass: mapped ones are
some ten times as wide as the vectors, and are stored nowhere.

The loss is smoothed by a quadratic piece of width ``delta``, which is narrowed
until the duality gap is small: the slopes of the smoothed loss are a point of
the dual problem, so ``gap`` bounds how far the returned ``objective`` lies above
the least one, whatever happened on the way. A fit whose gap does not come below
``GAP`` of the objective raises. At first a width is left as soon as little of the
gap is its own; where that leads nowhere, the fit starts again and finishes each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import Rounds

EPSILON = 0.1
GAP = 1e-3  # largest duality gap, as a share of the objective
NARROWER = 0.2  # the smoothing width shrinks by this factor
ENOUGH = 0.01  # at first the width is narrowed once a step promises less than this share of the gap
HURRIED = 5  # such widths, and steps for one
STEPS = 60  # Newton steps for one width
WIDTHS = 40
_LENGTHS = 0.25 ** np.arange(12)  # step lengths tried in one pass,
_DAMPED = (1e-10, 1e-6, 1e-3, 1e-1)  # for each of these dampings, relative to the largest curvature
_BLOCK = 1_024  # rows of a block
_PACKED = 4 * _BLOCK  # and of a packed record, about
_RIDGE = 1e-10  # least eigenvalue kept, relative to the largest


def gaussian(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    far = x @ (-2.0 * landmarks.T)
    far += np.einsum("ij,ij->i", x, x)[:, None]
    far += (landmarks * landmarks).sum(axis=1)
    np.maximum(far, 0.0, out=far)
    far *= -gamma
    return np.exp(far, out=far)


def _landmarks(train: DataFrame, size: int) -> np.ndarray:
    """``size`` distinct feature rows of the least hash; rows beyond the last hash are not shuffled."""
    hashed = train.select(vector_to_array("features").alias("x")).withColumn("h", F.xxhash64("x"))
    least = hashed.select("h").distinct().orderBy("h").limit(size).agg(F.max("h")).first()[0]
    rows = hashed.where(F.col("h") <= F.lit(least)).distinct().orderBy("h", "x").limit(size).collect()
    return np.array([r["x"] for r in rows], float)


def _projection(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(gaussian(landmarks, landmarks, gamma))
    keep = values > _RIDGE * values[-1]
    return vectors[:, keep] / np.sqrt(values[keep])


def dense(vectors: pa.StructArray, width: int) -> np.ndarray:
    """Rows of unwrapped vectors, sparse or dense, as a matrix."""
    values = vectors.field("values")
    sizes = values.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sparse = vectors.field("type").to_numpy(zero_copy_only=False) == 0
    column[sparse[row]] = vectors.field("indices").filter(pa.array(sparse)).flatten().to_numpy(zero_copy_only=False)
    x = np.zeros((len(sizes), width))
    x[row, column] = values.flatten().to_numpy(zero_copy_only=False)
    return x


def packed(train: DataFrame, width: int) -> DataFrame:
    """``features`` of ``width`` entries and ``label`` of some thousand rows a record: the entries that are not zero, column by column."""

    def told(held: list[list[pa.Array]]) -> pa.RecordBatch:
        vectors, label = zip(*held, strict=True)
        x = np.concatenate([dense(v, width) for v in vectors])
        y = np.concatenate([v.to_numpy(zero_copy_only=False).astype(float) for v in label])
        column, row = np.nonzero(x.T)
        parts = np.bincount(column, minlength=width).astype(np.int32), row.astype(np.int32), x[row, column]
        return pa.RecordBatch.from_arrays([pa.array([z.tobytes()], pa.binary()) for z in (*parts, y)], ["n", "row", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, _PACKED):
                held.append(batch.slice(at, _PACKED).columns)
                n += len(held[-1][0])
                if n >= _PACKED:
                    yield told(held)
                    held, n = [], 0
        if n:
            yield told(held)

    rows = train.select(F.unwrap_udt("features").alias("x"), F.col("label").cast("double").alias("y"))
    return rows.mapInArrow(run, "n binary, row binary, x binary, y binary")


def _opened(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for r in batch.to_pylist():
        y = np.frombuffer(r["y"])
        x = np.zeros((len(y), width))
        x[np.frombuffer(r["row"], np.int32), np.repeat(np.arange(width), np.frombuffer(r["n"], np.int32))] = np.frombuffer(r["x"])
        for at in range(0, len(y), _BLOCK):
            yield x[at : at + _BLOCK], y[at : at + _BLOCK]


def summed(blocks: DataFrame, width: int, work: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: int) -> np.ndarray:
    """The sum over all ``packed`` rows of ``work(x, y)``, a matrix of ``rows`` rows.

    Blocks are added up in their task; the parts meet by row, so no task and not
    the driver holds more than one matrix and the parts of some rows.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x, y in _opened(batch, width):
                part = work(x, y)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def meet(parts: pa.Table) -> pa.Table:
        columns = parts.column("v").combine_chunks()
        total = columns.flatten().to_numpy().reshape(len(columns), -1).sum(axis=0)
        return pa.table({"i": parts.column("i").slice(0, 1), "v": pa.array([total], pa.list_(pa.float64()))})

    kind = "i int, v array<double>"
    parts = blocks.mapInArrow(add, kind)
    if parts.rdd.getNumPartitions() > 64:  # many parts: add them up on the executors
        parts = parts.groupBy("i").applyInArrow(meet, kind)
    told = parts.toArrow()
    total = np.zeros((rows, len(told["v"][0].as_py()))) if told.num_rows else np.zeros((rows, 1))
    np.add.at(total, told["i"].to_numpy(), np.array(told["v"].to_pylist(), float))
    return total


def _slopes(left: np.ndarray, delta: float) -> np.ndarray:
    """Derivative of the smoothed loss by the residual, within -1 and 1."""
    return np.sign(left) * np.clip((np.abs(left) - EPSILON) / delta, 0.0, 1.0)


def _losses(left: np.ndarray, delta: float) -> np.ndarray:
    """The smoothed loss of each column of residuals, which are used up."""
    np.abs(left, out=left)
    left -= EPSILON
    np.maximum(left, 0.0, out=left)
    bent = np.minimum(left, delta)  # on the quadratic piece all of it, beyond it the width
    left -= 0.5 * bent
    return np.einsum("ij,ij->j", bent, left) / delta


def _curved(kernel: Callable[[np.ndarray], np.ndarray], projection: np.ndarray, w: np.ndarray, cost: float, delta: float):
    """Per block: curvature, gradient, and the figures of the primal and dual problem.

    Only rows on the loss's quadratic piece are projected one by one; the
    gradients are sums of kernel rows, for the driver to project.
    """
    weights, width = projection @ w[:-1], len(w)

    def work(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = kernel(x)
        left = y - k @ weights - w[-1]
        slope = _slopes(left, delta)
        near = k[(np.abs(left) > EPSILON) & (np.abs(left) < EPSILON + delta)]
        near = np.column_stack([near @ projection, np.ones(len(near))])
        up, down = np.maximum(slope, 0.0), np.maximum(-slope, 0.0)
        told = np.zeros((width + 5, max(width, k.shape[1], 2)))
        told[:width, :width] = cost / delta * (near.T @ near)
        told[width, : k.shape[1]], told[width + 1, : k.shape[1]] = up @ k, down @ k
        # Loss, plain and smoothed, and for either sign of the slope: its sum times label, and its sum.
        told[width + 2, 0] = np.maximum(np.abs(left) - EPSILON, 0.0).sum()
        told[width + 2, 1] = _losses(left[:, None].copy(), delta)[0]
        told[width + 3, :2], told[width + 4, :2] = (up @ y, up.sum()), (down @ y, down.sum())
        return told

    return work


def _projected(sums: np.ndarray, projection: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The curvature, and the figures with both gradients in mapped terms."""
    size, kept = projection.shape
    figures = np.zeros((5, max(kept + 1, 2)))
    for sign in (0, 1):
        figures[sign, : kept + 1] = np.append(sums[kept + 1 + sign, :size] @ projection, sums[kept + 4 + sign, 1])
    figures[2:, :2] = sums[kept + 3 :, :2]
    return sums[: kept + 1, : kept + 1], figures


def _gap(w: np.ndarray, cost: float, figures: np.ndarray) -> tuple[float, float]:
    """The objective, and how far it lies above a point of the dual problem.

    The dual asks the slopes to sum to zero: those of the heavier sign are scaled.
    """
    objective = 0.5 * w[:-1] @ w[:-1] + cost * figures[2, 0]
    (up_y, up), (down_y, down) = figures[3, :2], figures[4, :2]
    a, b = (1.0, up / down) if down > up else (down / up, 1.0) if up > 0 else (1.0, 1.0)
    point = cost * (a * figures[0] - b * figures[1])[: len(w) - 1]
    dual = -0.5 * point @ point + cost * (a * up_y - b * down_y) - EPSILON * cost * (a * up + b * down)
    return float(objective), float(objective - dual)


class KernelModel:
    """Landmarks, their weights and an intercept."""

    kind = "kernel"

    def __init__(self, landmarks: np.ndarray, weights: np.ndarray, intercept: float, gamma: float, objective: float, gap: float):
        self.landmarks, self.weights, self.intercept, self.gamma = landmarks, weights, intercept, gamma
        self.objective, self.gap = objective, gap

    def predict(self, df: DataFrame) -> DataFrame:
        landmarks, weights, intercept, gamma = self.landmarks, self.weights, self.intercept, self.gamma

        def answer(rows: pa.Array) -> pa.Array:
            if len(rows) == 0:
                return pa.array([], pa.float64())
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            told = [gaussian(x[at : at + _BLOCK], landmarks, gamma) @ weights + intercept for at in range(0, len(x), _BLOCK)]
            return pa.array(np.concatenate(told))

        return df.withColumn("prediction", F.arrow_udf(answer, "double")(vector_to_array("features"))).select(*df.columns, "prediction")

    def save(self, path: str, spark: SparkSession) -> dict:
        rows = [(i, x, float(v)) for i, (x, v) in enumerate(zip(self.landmarks.tolist(), self.weights, strict=True))]
        spark.createDataFrame(rows, "i int, x array<double>, weight double").coalesce(1).write.mode("overwrite").parquet(f"{path}/landmarks")
        return {"intercept": self.intercept, "gamma": self.gamma, "objective": self.objective, "gap": self.gap}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> "KernelModel":
        rows = spark.read.parquet(f"{path}/landmarks").orderBy("i").collect()
        return cls(np.array([r["x"] for r in rows], float), np.array([r["weight"] for r in rows]), **meta)


def fit_kernel(train: DataFrame, gamma: float, cost: float, landmarks: int) -> KernelModel:
    """Fit on ``features`` and ``label``; needs at least one row, and passes over a frame that is not cached from a cache."""
    if train.is_cached:
        return _fitted(train, gamma, cost, landmarks)
    kept = train.select("features", "label").persist()
    try:
        return _fitted(kept, gamma, cost, landmarks)
    finally:
        kept.unpersist()


def _fitted(train: DataFrame, gamma: float, cost: float, landmarks: int) -> KernelModel:
    points = _landmarks(train, landmarks)
    middle = train.agg(F.percentile_approx("label", 0.5).cast("double"), F.stddev_pop("label")).first()
    written = Rounds()
    try:
        return _solved(written.write(packed(train, points.shape[1])), points, middle, gamma, cost)
    finally:
        written.close(train.sparkSession)


def _solved(blocks: DataFrame, points: np.ndarray, middle, gamma: float, cost: float) -> KernelModel:
    projection = _projection(points, gamma)
    entries, width = points.shape[1], projection.shape[1] + 1

    def kernel(x: np.ndarray) -> np.ndarray:
        return gaussian(x, points, gamma)

    w = np.zeros(width)
    w[-1] = middle[0]
    delta = max(middle[1] or 0.0, EPSILON)
    penalty = np.append(np.ones(width - 1), 0.0)
    best = [np.inf, np.inf]

    def at(w: np.ndarray, delta: float):
        """Smoothed objective, curvature and figures."""
        curvature, figures = _projected(summed(blocks, entries, _curved(kernel, projection, w, cost, delta), width + 5), projection)
        return 0.5 * penalty @ (w * w) + cost * figures[2, 1], curvature, figures

    def descended(w: np.ndarray, delta: float, enough: float) -> KernelModel | None:
        for _ in range(HURRIED if enough else WIDTHS):
            value, curvature, figures = at(w, delta)
            for _ in range(HURRIED if enough else STEPS):
                objective, gap = _gap(w, cost, figures)
                if objective < best[0]:
                    best[:] = objective, gap
                if gap <= GAP * objective:
                    return KernelModel(points, projection @ w[:-1], float(w[-1]), gamma, objective, gap)
                gradient = penalty * w - cost * (figures[0] - figures[1])[:width]
                hessian, top = curvature + np.diag(penalty), max(cost, float(curvature.diagonal().max()))
                directions = [np.linalg.solve(hessian + damped * top * np.eye(width), gradient) for damped in _DAMPED]
                gain = float(gradient @ directions[0])
                if gain <= max(1e-12 * max(objective, 1.0), enough * gap):
                    break  # this width is done
                ahead = w - directions[0]
                told = at(ahead, delta)
                if not told[0] <= value - 0.1 * gain:
                    tried = np.column_stack([w, *(w - length * d for d in directions for length in _LENGTHS)])
                    weights, shifts = projection @ tried[:-1], tried[-1]

                    def losses(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                        left = kernel(x) @ weights
                        left += shifts - y[:, None]
                        return _losses(left, delta)[None, :]

                    values = 0.5 * (penalty @ (tried * tried)) + cost * summed(blocks, entries, losses, 1)[0]
                    least = int(np.argmin(values))
                    if values[least] >= values[0] - 1e-12 * max(objective, 1.0):
                        if enough:
                            return None
                        break
                    ahead = tried[:, least]
                    told = at(ahead, delta)
                w, (value, curvature, figures) = ahead, told
            delta *= NARROWER
        return None

    model = descended(w, delta, ENOUGH) or descended(w, delta, 0.0)
    if model is not None:
        return model
    raise RuntimeError(f"duality gap {best[1]:.3g} at objective {best[0]:.6g} after all widths")
