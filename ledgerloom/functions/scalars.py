"""Scalar expressions for cleaning, rounding and coercion."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts a CSV reader of the pandas family takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Tried in this order; numeric dates with the day first need a format of their own.
DATE_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "yyyy-M-d H:m[:s[.SSSSSSSSS]]", "yyyy-M-d'T'H:m[:s[.SSSSSSSSS]][XXX]",
    "yyyy/M/d H:m[:s]", "M/d/yyyy H:m[:s]", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "yyyyMMdd",
)

_DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~c.isin(*NA_TOKENS), c)


def nan_to_null(c: Column | str) -> Column:
    """Spark aggregates keep NaN; the results here must skip it like NULL."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def parse_date(c: Column | str, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """Lenient date parsing: the first format that fits, else NULL."""
    text = F.trim(as_col(c))
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def parse_number(c: Column | str, as_type: str = "double") -> Column:
    """Finite decimal text to a number; everything else (also NaN and inf) is NULL."""
    c = as_col(c)
    return F.when(c.rlike(_DECIMAL_TEXT), F.trim(c).try_cast(as_type))


def parse_integer(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(c.rlike(_INTEGER_TEXT), F.trim(c).try_cast("int"))


def mean_of(c: Column | str) -> Column:
    """Mean as one exact decimal sum and one division, NULL for no values."""
    c = as_col(c)
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def fixed4(c: Column | str) -> Column:
    """Quantise to 1e-4 with the same floating-point steps in every engine."""
    return F.floor(as_col(c) * F.lit(1e4) + F.lit(0.5)).cast("double") / F.lit(1e4)


def half_even_int(c: Column | str) -> Column:
    return F.rint(as_col(c)).cast("bigint")


def half_even(c: Column | str, digits: int) -> Column:
    return F.bround(as_col(c), digits)


def truncated(c: Column | str) -> Column:
    return as_col(c).cast("bigint")


def clamp(c: Column | str, low=None, high=None) -> Column:
    """Bound a value; NULL stays NULL although greatest/least skip NULL."""
    value = as_col(c)
    bounded = value
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    return F.when(value.isNotNull(), bounded)


def discounted_sales(price: Column | str, quantity: Column | str, discount: Column | str) -> Column:
    """price x quantity x (1 - discount percent)."""
    return as_col(price) * as_col(quantity) * (F.lit(1) - as_col(discount) / F.lit(100))


def iqr_scale(q1: Column | str, q3: Column | str) -> Column:
    """Interquartile range with a floor for segments of constant value."""
    q1, q3 = as_col(q1), as_col(q3)
    return F.when(q3 - q1 > F.lit(1e-9), q3 - q1).otherwise(F.greatest(q3 * F.lit(0.10), F.lit(1.0)))


def iso_date_text(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd")
