"""Fit, compare, refit and keep models."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import regressors as rg
from ledgerloom.operators.evaluation import error_metrics, ranked_models
from ledgerloom.operators.features import TASKS, Task, feature_pipeline, train_test_split

ROWS_PER_TASK = 100_000  # training rows in a part of the cached vectors


class TaskModel:
    """A fitted regressor with the feature preparation it was trained on.

    ``version`` names a published model's version.
    """

    version: str | None = None

    def __init__(self, spark: SparkSession, task: Task, name: str, prepared: PipelineModel, core):
        self.spark, self.task, self.name, self.prepared, self.core = spark, task, name, prepared, core

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``; needs ``row_key`` and the task's columns."""
        ready = _vectors(self.prepared, df, self.task) if getattr(self.core, "needs_vectors", True) else df
        return self.core.predict(ready).select(*df.columns, "prediction")

    def save(self, path: str) -> None:
        self.prepared.write().overwrite().save(f"{path}/prepared")
        meta = {"task": self.task.name, "name": self.name, "kind": self.core.kind, "core": self.core.save(f"{path}/core", self.spark)}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TaskModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        core = rg.KINDS[meta["kind"]].load(spark, f"{path}/core", meta["core"])
        return cls(spark, TASKS[meta["task"]], meta["name"], PipelineModel.load(f"{path}/prepared"), core)


def _vectors(prepared: PipelineModel, df: DataFrame, task: Task) -> DataFrame:
    """Adds ``features``."""
    return prepared.transform(df).select(*df.columns, "features")


def _kept(prepared: PipelineModel, train: DataFrame, task: Task) -> DataFrame:
    """The training vectors, cached in parts of at most about ``ROWS_PER_TASK`` rows.

    A table's files follow the shuffle that wrote it, so their rows, and with
    them what one task reads from the cache, would grow with the input.
    """
    parts = -(-train.count() // ROWS_PER_TASK)
    return _vectors(prepared, train.repartition(parts) if parts > 1 else train, task).persist()


def fit_model(train: DataFrame, task: Task, name: str, profile: rg.Profile | None = None) -> TaskModel:
    """Prepare features on ``train`` and fit one candidate, at full size unless a profile is given."""
    profile = profile or rg.FULL[task.name]
    prepared = feature_pipeline(task.cats, task.nums).fit(train)
    ready = _kept(prepared, train, task)
    try:
        return TaskModel(train.sparkSession, task, name, prepared, {**rg.CANDIDATES, **rg.EXTRAS}[name](ready, task, profile))
    finally:
        ready.unpersist()


def fit_candidates(
    train: DataFrame, test: DataFrame, task: Task, names: Iterable[str] = tuple(rg.CANDIDATES), profile: rg.Profile | None = None
) -> tuple[dict[str, TaskModel], DataFrame]:
    """Fit each candidate on ``train``; (models, one metric row per model on ``test``).

    Features are prepared once, and the vectors are cached for all fits.
    """
    names, profile = list(names), profile or rg.FULL[task.name]
    prepared = feature_pipeline(task.cats, task.nums).fit(train)
    ready = _kept(prepared, train, task)
    try:
        cores = rg.side_by_side(lambda name: rg.CANDIDATES[name](ready, task, profile), names)
    finally:
        ready.unpersist()
    models = {name: TaskModel(train.sparkSession, task, name, prepared, core) for name, core in zip(names, cores)}
    rows = rg.side_by_side(
        lambda name: error_metrics(models[name].predict(test)).select(
            F.lit(task.name).alias("task"),
            F.lit(name).alias("model"),
            "mae", "rmse", "r2",
            F.lit(list(rg.CANDIDATES).index(name)).alias("ordinal"),
            F.lit(profile.name).alias("profile"),
        ),
        names,
    )
    return models, reduce(DataFrame.unionByName, rows)


def model_comparison(results: DataFrame) -> DataFrame:
    """The comparison table, best model first within its task."""
    return ranked_models(results).orderBy("task", "place").select("task", "place", "model", "mae", "rmse", "r2", "profile")


def write_comparison(results: DataFrame, path: str) -> None:
    results.select("model", "mae", "rmse", "r2").toDF("Model", "MAE", "RMSE", "R2").coalesce(1).write.mode(
        "overwrite"
    ).option("header", True).csv(path)


def refit_best(
    rows: DataFrame, task: Task, names: Iterable[str] = tuple(rg.CANDIDATES), profile: rg.Profile | None = None, *, holdout: str = "hash"
) -> tuple[TaskModel, DataFrame]:
    """Compare on the held-out part, then refit the winner on all rows."""
    train, test = train_test_split(rows, holdout=holdout)
    _, results = fit_candidates(train, test, task, names, profile)
    table = model_comparison(results).collect()
    compared = rows.sparkSession.createDataFrame(table)
    return fit_model(rows, task, table[0]["model"], profile), compared
