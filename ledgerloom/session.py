"""Session settings, shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only after its rows were counted and found below this.
BROADCAST_ROWS = 200_000

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows may hold whole documents: small batches bound a Python worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings every job here relies on to a running session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run on workers are found there whatever folder the driver
    runs in. Spark serves the archive from the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="ledgerloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = shutil.make_archive(
        os.path.join(folder, "ledgerloom"), "zip", root_dir=os.path.dirname(package), base_dir=os.path.basename(package)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    default = os.path.join(tempfile.gettempdir(), f"ledgerloom-{os.getpid()}")
    if not os.path.isdir(default):
        os.makedirs(default)
        atexit.register(shutil.rmtree, default, ignore_errors=True)
    return default


_scopes = threading.local()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for held in getattr(_scopes, "stack", [])[-1:]:
        held.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables made in this block at its end.

    For jobs that write their result before the block ends, such as one
    micro-batch of a stream.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared folder and read that.

    Later passes start from the written table: they survive lost executors,
    read only the columns they need, and the planner knows the table's size.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The state of a loop, written anew in each round; only the newest table is kept.

    A state must not be read once the next one is written.
    """

    def __init__(self):
        self._path: str | None = None

    def write(self, df: DataFrame) -> DataFrame:
        spark, path = df.sparkSession, scratch_path(df.sparkSession, "round")
        df.write.parquet(path)
        self.close(spark)
        self._path = path
        return spark.read.schema(df.schema).parquet(path)

    def close(self, spark: SparkSession) -> None:
        if self._path is not None:
            _delete(spark, self._path)
            self._path = None


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now.

    It does so once the driver has collected their plans, which a driver with
    a large heap may put off for longer than a loop's files fit on disk.
    """
    gc.collect()
    spark._jvm.System.gc()


def size_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise an aggregate and broadcast it only if it is small enough.

    Larger tables come back without the hint, so the join shuffles and the
    adaptive planner splits its hot keys.
    """
    kept = materialise(df)
    small = kept.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(kept) if small else kept
