"""Row cleaning, calendar columns and column sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import parse_number

SERVING_KEYS = ("order_date", "unit_price", "discount", "category", "sub_category", "region", "city")
TRAINING_KEYS = (
    "order_date", "sales", "quantity", "unit_price", "discount",
    "category", "sub_category", "region", "city",
)
EXPANSION_KEYS = ("order_date", "quantity", "unit_price", "discount")
NUMERIC_COLUMNS = ("quantity", "unit_price", "discount", "sales", "profit")
SEGMENT_KEYS = ("category", "sub_category", "region")
LEAK_COLUMNS = ("order_id", "customer_name", "product_name", "payment_mode", "profit", "order_date")


def coerce_numeric(df: DataFrame, columns=NUMERIC_COLUMNS) -> DataFrame:
    """Text columns to double; what is no finite number becomes NULL."""
    return df.withColumns({c: parse_number(c) for c in columns if c in df.columns})


def drop_incomplete(df: DataFrame, keys=SERVING_KEYS) -> DataFrame:
    """Drop rows with a NULL in any key column the table has."""
    return df.na.drop(subset=[k for k in keys if k in df.columns])


def calendar_features(df: DataFrame, date: str = "order_date") -> DataFrame:
    return df.withColumns(
        {
            "order_year": F.year(date),
            "order_month": F.month(date),
            "order_quarter": F.quarter(date),
        }
    )


def project_features(df: DataFrame) -> DataFrame:
    """Drop identifiers and leaks, keep calendar columns, keys and measures."""
    return df.drop(*LEAK_COLUMNS)


def stringify_keys(df: DataFrame, keys=SEGMENT_KEYS) -> DataFrame:
    """Segment keys as text; a missing key is the text ``nan``."""
    return df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("nan")) for k in keys})


def filter_segment(df: DataFrame, category=None, sub_category=None, region=None, year=None, month=None) -> DataFrame:
    """Conjunctive equality filter; parts left out do not restrict."""
    wanted = {
        "category": category, "sub_category": sub_category, "region": region,
        "order_year": year, "order_month": month,
    }
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def positive_sales(df: DataFrame) -> DataFrame:
    return df.where((F.col("sales") > 0) & F.col("profit").isNotNull())


def append_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by column name; a column only one side has is NULL on the other."""
    return old.unionByName(new, allowMissingColumns=True)


def with_keys(df: DataFrame, keys) -> DataFrame:
    """Grouped results have no row for a missing key."""
    return df.na.drop(subset=list(keys))
