"""Monthly series: building, gap filling, lags, trailing means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALL_SERIES = "All"
_MONEY = "decimal(18,2)"


def monthly_sales_series(sales: DataFrame) -> DataFrame:
    """Sales per month and category, plus the ``All`` series.

    The total comes from the per-category sums, not from a second pass.
    """
    cells = (
        sales.where(F.col("order_date").isNotNull())
        .groupBy(F.trunc("order_date", "month").alias("month"), F.col("category").alias("series_key"))
        .agg(F.sum("sales").alias("value"))
    )
    total = cells.groupBy("month").agg(F.sum("value").alias("value")).withColumn("series_key", F.lit(ALL_SERIES))
    # A category that bears the total's name is a series of its own, told apart by quotes.
    named = F.when(F.col("series_key") == ALL_SERIES, F.lit(f"'{ALL_SERIES}'")).otherwise(F.col("series_key"))
    both = cells.where(F.col("series_key").isNotNull()).withColumn("series_key", named).unionByName(total)
    return both.select("series_key", "month", F.col("value").cast(_MONEY).alias("value"))


def drop_partial_month(series: DataFrame, sales: DataFrame) -> DataFrame:
    """Drop the last month unless the table reaches the month's last day."""
    latest = sales.agg(F.max("order_date").alias("d"))
    open_month = latest.select(
        F.when(F.col("d") < F.last_day("d"), F.trunc("d", "month")).otherwise(F.add_months(F.trunc("d", "month"), 1))
    ).scalar()
    return series.where(F.col("month") < open_month)


def fill_months(series: DataFrame) -> DataFrame:
    """Continuous months from each series' first one to the table's last; gaps are 0."""
    last = series.agg(F.max("month")).scalar()
    axis = (
        series.groupBy("series_key")
        .agg(F.min("month").alias("first"))
        .select("series_key", F.explode(F.sequence("first", last, F.expr("interval 1 month"))).alias("month"))
    )
    return axis.join(series, ["series_key", "month"], "left").select(
        "series_key", "month", F.coalesce("value", F.lit(0)).cast(_MONEY).alias("value")
    )


def series_lag(series: DataFrame) -> DataFrame:
    """Previous month's value and the difference, per series."""
    ordered = W.partitionBy("series_key").orderBy("month")
    return series.withColumn("previous", F.lag("value").over(ordered)).withColumn(
        "difference", F.col("value") - F.col("previous")
    )


def moving_average(series: DataFrame, window: int = 3) -> DataFrame:
    """Trailing mean over up to ``window`` months, per series."""
    trailing = W.partitionBy("series_key").orderBy("month").rowsBetween(-(window - 1), 0)
    mean = F.sum("value").over(trailing).cast("double") / F.count("value").over(trailing)
    return series.withColumn("moving_average", mean)


def histories(series: DataFrame) -> DataFrame:
    """One row per series with its values in month order.

    The list is as long as the calendar has months, whatever the data size.
    """
    points = F.array_sort(F.collect_list(F.struct("month", "value")))
    return series.groupBy("series_key").agg(points.alias("points")).select(
        "series_key",
        F.transform("points", lambda p: p["month"]).alias("months"),
        F.transform("points", lambda p: p["value"]).alias("y"),
        F.size("points").alias("n"),
    )
