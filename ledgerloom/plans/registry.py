"""Published models: versioned folders and one pointer per task.

``root/<task>/versions/<version>`` holds a saved model and the comparison that
chose it. ``root/<task>/current`` names the version that is served; it is
replaced by an atomic rename, so a reader sees the old version or the new one,
never half of one. Old versions stay until ``prune`` removes them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import regressors as rg
from ledgerloom.operators.features import Task
from ledgerloom.plans.training import TaskModel, refit_best


class ModelRegistry:
    """Models below one folder that all executors and drivers share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._held: dict[str, TaskModel] = {}

    def publish(self, model: TaskModel, compared: DataFrame | None = None) -> str:
        """Save a model as a new version, then serve it."""
        task = model.task.name
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        model.save(f"{self._versions(task)}/{version}/model")
        if compared is not None:
            compared.write.parquet(f"{self._versions(task)}/{version}/comparison")
        self._point(task, version)
        return version

    def current(self, task: str) -> str:
        """The version that is served."""
        path = self._path(f"{self.root}/{task}/current")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            raise LookupError(f"no model is published for {task}")
        stream = files.open(path)
        try:
            told = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(told)["version"]

    def load(self, task: str) -> TaskModel:
        """The served model, marked with its version; read again only after a new one was published."""
        version = self.current(task)
        held = self._held.get(task)
        if held is None or held.version != version:
            held = TaskModel.load(self.spark, f"{self._versions(task)}/{version}/model")
            held.version = version
            self._held[task] = held
        return held

    def comparison(self, task: str) -> DataFrame:
        """The comparison that chose the served model."""
        return self.spark.read.parquet(f"{self._versions(task)}/{self.current(task)}/comparison")

    def versions(self, task: str) -> list[str]:
        """All versions, oldest first."""
        path = self._path(self._versions(task))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def prune(self, task: str, keep: int = 3) -> list[str]:
        """Remove all but the newest versions and the served one; those removed."""
        names, served = self.versions(task), self.current(task)
        gone = [v for v in names[: max(len(names) - keep, 0)] if v != served]
        for version in gone:
            path = self._path(f"{self._versions(task)}/{version}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone

    def rollback(self, task: str, version: str) -> None:
        """Serve an earlier version again."""
        if version not in self.versions(task):
            raise LookupError(f"{task} has no version {version}")
        self._point(task, version)

    def _versions(self, task: str) -> str:
        return f"{self.root}/{task}/versions"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _point(self, task: str, version: str) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        settings = self.spark._jsc.hadoopConfiguration()
        target, draft = self._path(f"{self.root}/{task}/current"), self._path(f"{self.root}/{task}/.next-{uuid.uuid4().hex}")
        out = draft.getFileSystem(settings).create(draft)
        out.write(bytearray(json.dumps({"version": version}).encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), settings).rename(draft, target, how)


def train_and_publish(
    rows: DataFrame,
    task: Task,
    registry: ModelRegistry,
    names: Iterable[str] = tuple(rg.CANDIDATES),
    profile: rg.Profile | None = None,
    *,
    holdout: str = "hash",
) -> tuple[str, TaskModel]:
    """Compare all candidates, refit the winner on all rows, publish it: (version, the model as fitted)."""
    model, compared = refit_best(rows, task, names, profile, holdout=holdout)
    return registry.publish(model, compared), model
