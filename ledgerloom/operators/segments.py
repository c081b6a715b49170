"""Aggregates over sales: demand cells, segment profiles, frequencies, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import iqr_scale, mean_of
from ledgerloom.operators.cleaning import SEGMENT_KEYS, positive_sales, stringify_keys, with_keys
from ledgerloom.operators.quantiles import exact_quantiles

CELL_KEYS = ("order_year", "order_month", "category", "sub_category", "region")
FIRST_ORDER_ID = 100_000


def demand_cells_train(sales: DataFrame) -> DataFrame:
    """Monthly segment cells with their total quantity, for training."""
    return with_keys(sales, CELL_KEYS).groupBy(*CELL_KEYS).agg(
        F.sum("quantity").cast("bigint").alias("total_quantity"),
        mean_of("unit_price").alias("avg_unit_price"),
        mean_of("discount").alias("avg_discount"),
        F.count("quantity").alias("orders_count"),
    )


def demand_cells_serve(sales: DataFrame) -> DataFrame:
    """Monthly segment cells as the scoring side counts them (rows with a discount)."""
    return with_keys(sales, CELL_KEYS).groupBy(*CELL_KEYS).agg(
        mean_of("unit_price").alias("avg_unit_price"),
        mean_of("discount").alias("avg_discount"),
        F.count("discount").alias("orders_count"),
    )


def segment_stats(cells: DataFrame, weighted: bool = False) -> DataFrame:
    """Per segment: mean of its cell means, truncated mean of its cell counts.

    ``weighted=True`` weighs each cell by its order count instead.
    """
    if weighted:
        def mean(c):
            return F.try_divide(F.sum(F.col(c) * F.col("orders_count")), F.sum("orders_count"))
    else:
        mean = F.avg
    return with_keys(cells, SEGMENT_KEYS).groupBy(*SEGMENT_KEYS).agg(
        mean("avg_unit_price").alias("avg_unit_price"),
        mean("avg_discount").alias("avg_discount"),
        F.avg("orders_count").cast("bigint").alias("orders_count"),
    )


def global_stats(sales: DataFrame) -> DataFrame:
    """One row over the whole table; the count is the table's row count."""
    return sales.agg(
        mean_of("unit_price").alias("avg_unit_price"),
        mean_of("discount").alias("avg_discount"),
        F.count(F.lit(1)).alias("orders_count"),
    )


def value_frequency(df: DataFrame, columns, by=(), weight: str | None = None) -> DataFrame:
    """Count of each value and its share, overall or within a parent key.

    Parent totals come from a second, small aggregate and a join. A window over
    the parent would send all values of a hot parent to one task.
    """
    columns, by = list(columns), list(by)
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counts = with_keys(df, [*by, *columns]).groupBy(*by, *columns).agg(amount.cast("bigint").alias("n"))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
        counts = counts.join(totals, by)
        total = F.col("_total")
    else:
        total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n").cast("double") / total.cast("double")).drop("_total")


def segment_frequency(sales: DataFrame) -> DataFrame:
    """Rows per segment and the segment's probability."""
    return value_frequency(stringify_keys(sales), SEGMENT_KEYS)


def segment_profile(sales: DataFrame) -> DataFrame:
    """Median, quartiles and IQR scale of price, discount and quantity per segment."""
    measures = {"price": F.col("unit_price"), "disc": F.col("discount"), "qty": F.col("quantity")}
    measures["sales"] = F.col("sales") if "sales" in sales.columns else F.col("unit_price")
    found = exact_quantiles(stringify_keys(sales), SEGMENT_KEYS, measures, (0.25, 0.5, 0.75))

    def pick(measure: str, at: int):
        return F.max(F.when(F.col("measure") == measure, F.col("q")[at]))

    wide = found.groupBy(*SEGMENT_KEYS).agg(
        *[
            pick(measure, at).alias(f"{measure}_{name}")
            for measure in ("price", "disc", "qty")
            for name, at in (("med", 1), ("q1", 0), ("q3", 2))
        ],
        pick("sales", 1).alias("sales_med"),
    )
    return wide.withColumns({f"{m}_scale": iqr_scale(f"{m}_q1", f"{m}_q3") for m in ("price", "disc", "qty")})


def option_lists(sales: DataFrame) -> DataFrame:
    """Sorted choices per form field: rows (option, value).

    One pass reduces the table to its distinct key combinations; the five
    lists come out of that small result.
    """
    combos = sales.select(
        "category", "sub_category", "region", F.col("city"), F.col("order_year").cast("string").alias("year")
    ).distinct()
    listed = combos.unpivot([], ["category", "sub_category", "region", "city", "year"], "option", "value")
    months = sales.sparkSession.range(1, 13).select(
        F.lit("month").alias("option"), F.lpad(F.col("id").cast("string"), 2, "0").alias("value")
    )
    return listed.where(F.col("value").isNotNull()).distinct().unionByName(months).orderBy("option", "value")


def subcategories_of(sales: DataFrame, category: str | None = None) -> DataFrame:
    """The dependent choice list, for one category or for all of them."""
    rows = with_keys(sales, ("category", "sub_category"))
    if category is not None:
        rows = rows.where(F.col("category") == F.lit(category))
    return rows.select("category", "sub_category").distinct().orderBy("category", "sub_category")


def median_margin_by_category(sales: DataFrame) -> DataFrame:
    margin = F.try_divide(F.col("profit").cast("double"), F.col("sales").cast("double"))
    found = exact_quantiles(with_keys(positive_sales(sales), ["category"]), ["category"], {"margin": margin}, (0.5,))
    return found.select("category", F.col("q")[0].alias("median_margin"))


def latest_period(sales: DataFrame) -> DataFrame:
    latest = sales.agg(F.max("order_date").alias("latest_date"))
    return latest.select(
        "latest_date",
        F.year("latest_date").alias("order_year"),
        F.month("latest_date").alias("order_month"),
        F.quarter("latest_date").alias("order_quarter"),
    )


def next_order_id(sales: DataFrame) -> DataFrame:
    if "order_id" not in sales.columns:
        return sales.agg(F.lit(FIRST_ORDER_ID).cast("bigint").alias("next_order_id"))
    return sales.agg(
        F.coalesce(F.max("order_id") + 1, F.lit(FIRST_ORDER_ID)).cast("bigint").alias("next_order_id")
    )


def row_report(sales: DataFrame, target_rows: int) -> DataFrame:
    counted = sales.agg(F.count(F.lit(1)).alias("rows_before"))
    to_add = F.greatest(F.lit(0), F.lit(target_rows) - F.col("rows_before")).cast("bigint")
    return counted.select("rows_before", to_add.alias("rows_to_add"), (F.col("rows_before") + to_add).alias("rows_after"))
