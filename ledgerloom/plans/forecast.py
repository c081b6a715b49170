"""Monthly sales forecast for every category at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import forecasting as fc
from ledgerloom.operators import series as sr
from ledgerloom.session import materialise

DEFAULT_HORIZON = 12


def series_histories(sales: DataFrame, *, drop_partial: bool = False) -> DataFrame:
    """Filled monthly histories, one row per series."""
    series = sr.monthly_sales_series(sales)
    if drop_partial:
        series = sr.drop_partial_month(series, sales)
    return sr.histories(sr.fill_months(series))


def forecast_sales(
    sales: DataFrame, horizon: int = DEFAULT_HORIZON, category: str | None = None, *, drop_partial: bool = False
) -> DataFrame:
    """Rows (series_key, month, kind, value, model_name, mape); ``category=None`` is every series.

    A series too short to hold months out is continued by the moving average,
    without an error measure. ``drop_partial`` leaves out a last month that the
    table does not reach the end of.

    Only the monthly histories, a few hundred values per series, are kept
    between the backtest and the final fit.
    """
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    history = series_histories(sales, drop_partial=drop_partial)
    if category is not None:
        history = history.where(F.col("series_key") == F.lit(category))
    history = materialise(history.withColumn("horizon", F.lit(horizon)))
    fitted = fc.chosen_paths(history, choices(history))
    last = F.element_at("months", -1)
    past = F.transform(
        F.arrays_zip("months", "y"),
        lambda p: F.struct(p["months"].alias("month"), F.lit("history").alias("kind"), p["y"].cast("double").alias("value")),
    )
    ahead = F.transform(
        "path",
        lambda v, i: F.struct(F.add_months(last, i + 1).alias("month"), F.lit("forecast").alias("kind"), v.alias("value")),
    )
    return fitted.select("series_key", "model_name", "mape", F.explode(F.concat(past, ahead)).alias("p")).select(
        "series_key", "p.month", "p.kind", "p.value", "model_name", "mape"
    )


def choices(history: DataFrame) -> DataFrame:
    """series_key, model_name, mape for every history; short ones take the first, plainest model."""
    chosen = fc.select_forecast_model(fc.backtest_mape(history))
    plain = next(iter(fc.CANDIDATES))
    return history.select("series_key").join(chosen, "series_key", "left").withColumn(
        "model_name", F.coalesce("model_name", F.lit(plain))
    )


def answer_forecasts(requests: DataFrame, sales: DataFrame, *, drop_partial: bool = False) -> DataFrame:
    """``requests`` (any columns, horizon, category, error) with ``response``, a JSON text each.

    Each request has its own horizon. Rejected requests and those
    ``forecast_status`` refuses answer with their error.
    """
    history = materialise(series_histories(sales, drop_partial=drop_partial))
    chosen = materialise(choices(history))
    asked = requests.withColumnRenamed("error", "_rejected").withColumn("series_key", F.col("category"))
    asked = forecast_status(asked, history).withColumn("error", F.coalesce("_rejected", "error")).drop("_rejected")
    # One path per series and horizon asked for, however many requests ask.
    wanted = asked.where(F.col("error").isNull()).select("series_key", "horizon").distinct()
    paths = fc.chosen_paths(history.join(wanted, "series_key"), chosen)
    name = F.transform("months", lambda m: F.date_format(m, "yyyy-MM"))
    ahead = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.date_format(F.add_months(F.element_at("months", -1), i), "yyyy-MM"))
    money = lambda values: F.transform(values, lambda v: F.round(v.cast("double"), 2))
    answers = paths.select(
        "series_key", F.size("path").alias("horizon"),
        F.to_json(F.struct(
            F.struct(name.alias("dates"), money(F.col("y")).alias("values")).alias("history"),
            F.struct(ahead.alias("dates"), money(F.col("path")).alias("values")).alias("forecast"),
            "model_name", "mape",
        )).alias("_answer"),
    )
    refused = F.to_json(F.struct("error"))
    return asked.join(answers, ["series_key", "horizon"], "left").withColumn(
        "response", F.when(F.col("error").isNotNull(), refused).otherwise(F.col("_answer"))
    ).drop("_answer", "series_key")


def forecast_frame(forecast: DataFrame) -> DataFrame:
    """History and forecast on one month axis; the last history point opens the forecast line."""
    history = forecast.where(F.col("kind") == "history")
    bridge = history.groupBy("series_key").agg(F.max("month").alias("month"), F.max_by("value", "month").alias("bridge"))
    lines = forecast.select(
        "series_key",
        "month",
        F.when(F.col("kind") == "history", F.col("value")).alias("history_value"),
        F.when(F.col("kind") == "forecast", F.col("value")).alias("forecast_value"),
    )
    joined = lines.join(bridge, ["series_key", "month"], "left")
    return joined.select(
        "series_key", "month", "history_value", F.coalesce("forecast_value", "bridge").alias("forecast_value")
    )


def forecast_status(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``error`` to forecast requests (series_key, horizon); NULL means it can be served."""
    known = history.select("series_key", "n")
    joined = requests.join(known, "series_key", "left")
    error = (
        F.when(F.col("horizon").isNull() | (F.col("horizon") < 1), "bad_horizon")
        .when(F.col("n").isNull(), "unknown_category")
        .when(F.col("n") < 5, "insufficient_history")
    )
    return joined.select(*requests.columns, error.alias("error"))
