"""Training sets, feature vectors and the train/test split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.segments import CELL_KEYS, demand_cells_train
from ledgerloom.sources.sales import with_row_key


@dataclass(frozen=True)
class Task:
    """What a model predicts and from which columns."""

    name: str
    cats: tuple[str, ...]
    nums: tuple[str, ...]


DEMAND = Task(
    "demand",
    ("category", "sub_category", "region"),
    ("order_year", "order_month", "avg_unit_price", "avg_discount", "orders_count"),
)
SALES = Task(
    "sales",
    ("category", "sub_category", "region", "city"),
    ("unit_price", "discount", "order_month", "order_quarter", "order_year", "quantity"),
)
TASKS = {task.name: task for task in (DEMAND, SALES)}


def demand_training_set(sales: DataFrame) -> DataFrame:
    """One row per monthly cell: features and the cell's total quantity as label."""
    cells = demand_cells_train(sales)
    return cells.select(
        F.concat_ws("|", *[F.col(c).cast("string") for c in CELL_KEYS]).alias("row_key"),
        *DEMAND.cats,
        *[F.col(c).cast("double").alias(c) for c in DEMAND.nums],
        F.col("total_quantity").cast("double").alias("label"),
    )


def sales_training_set(sales: DataFrame, key: Column | str = "row_key") -> DataFrame:
    """One row per order line: features and its sales as label."""
    key = F.col(key) if isinstance(key, str) else key
    return sales.select(
        key.cast("string").alias("row_key"),
        *SALES.cats,
        *[F.col(c).cast("double").alias(c) for c in SALES.nums],
        F.col("sales").cast("double").alias("label"),
    )


def training_set(sales: DataFrame, task: Task) -> DataFrame:
    """The task's rows; order lines of a source without keys are given some."""
    if task is DEMAND:
        return demand_training_set(sales)
    return sales_training_set(sales if "row_key" in sales.columns else with_row_key(sales))


def with_split(df: DataFrame, key: str = "row_key", *, holdout: str = "hash", tenths: int = 2) -> DataFrame:
    """Adds ``in_test``: two tenths of the rows by default.

    ``hash`` depends on the row key alone, so partitioning and retries do not
    move rows. ``time`` holds out the latest months.
    """
    if holdout == "hash":
        bucket = F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("bigint") % 10
        return df.withColumn("in_test", bucket < tenths)
    if holdout != "time":
        raise ValueError("holdout is 'hash' or 'time'")
    month = (F.col("order_year") * 12 + F.col("order_month")).cast("int")
    edge = df.agg(F.percentile_approx(month, 1 - tenths / 10, 10_000)).scalar()
    return df.withColumn("in_test", month > edge)


def train_test_split(df: DataFrame, key: str = "row_key", *, holdout: str = "hash") -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, key, holdout=holdout)
    return marked.where(~F.col("in_test")).drop("in_test"), marked.where(F.col("in_test")).drop("in_test")


def feature_pipeline(cats, nums, output: str = "features") -> Pipeline:
    """One-hot categories and untouched numbers; an unseen category is all zeros.

    The indexer's extra slot for unseen values is the one the encoder drops.
    """
    cats = list(cats)
    indexed, encoded = [f"{c}_index" for c in cats], [f"{c}_onehot" for c in cats]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=cats, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
            VectorAssembler(inputCols=encoded + list(nums), outputCol=output),
        ]
    )


def vectorised(prepared: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``features`` and drops the helper columns."""
    return prepared.transform(df).drop(*[c for s in ("_index", "_onehot") for c in (f"{k}{s}" for k in df.columns)])
