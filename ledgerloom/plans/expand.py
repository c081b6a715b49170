"""Grow a sales table with rows drawn from its own distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.draws import standard_normal, uniform_int
from ledgerloom.functions.scalars import clamp, discounted_sales, half_even, half_even_int
from ledgerloom.operators.cleaning import EXPANSION_KEYS, SEGMENT_KEYS, append_rows, drop_incomplete, stringify_keys
from ledgerloom.operators.sampling import cumulative_weights, weighted_pick
from ledgerloom.operators.segments import (
    median_margin_by_category, next_order_id, segment_frequency, segment_profile, value_frequency,
)
from ledgerloom.session import materialise, size_checked
from ledgerloom.sources.sales import with_optional_columns

TARGET_ROWS = 80_000
FIRST_YEAR, LAST_YEAR = 2022, 2025
SEASONAL_STRENGTH = 0.30
HIGH_MONTHS, LOW_MONTHS = (11, 12), (2, 3)
DEFAULT_MARGIN, MARGIN_NOISE, MARGIN_RANGE = 0.15, 0.04, (0.01, 0.40)
MAX_DISCOUNT = 60.0

# The name lists customer names are built from.
FIRST_NAMES = (
    "Amina", "Sara", "Ali", "Omar", "Zain", "Nadia", "Riya", "Ishan", "Misha", "Anika", "Ayaan", "Kashvi",
)
LAST_NAMES = (
    "Khan", "Sharma", "Patel", "Singh", "Desai", "Gupta", "Acharya", "Chandra", "Thakur", "Ram", "Yadav",
)


def _by_month(high, low, other) -> Column:
    month = F.col("order_month")
    return F.when(month.isin(*HIGH_MONTHS), high).when(month.isin(*LOW_MONTHS), low).otherwise(other)


COUNT_KEYS = (
    "order_year", "order_month", "region", "city", "category", "sub_category", "product_name", "payment_mode",
)


def key_counts(sales: DataFrame) -> DataFrame:
    """Rows per combination of everything that is drawn by frequency, written once.

    All frequency tables are sums over this one, so the sales rows are counted
    in a single pass.
    """
    return materialise(sales.groupBy(*[k for k in COUNT_KEYS if k in sales.columns]).agg(F.count(F.lit(1)).alias("n")))


def _amount(weight: str | None) -> Column:
    return F.sum(weight) if weight else F.count(F.lit(1))


def month_weights(sales: DataFrame, strength: float = SEASONAL_STRENGTH, weight: str | None = None) -> DataFrame:
    """Twelve rows: month, its count (1 if absent) times the season factor, share.

    The weight is whole: the factor is counted in thousandths.
    """
    counts = sales.groupBy("order_month").agg(_amount(weight).alias("_n"))
    months = sales.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("order_month"))
    factor = _by_month(*(F.lit(round(1000 * f)).cast("bigint") for f in (1 + strength, 1 - strength / 2, 1.0)))
    rows = months.join(counts, "order_month", "left").select(
        "order_month", (F.coalesce("_n", F.lit(1)) * factor).cast("bigint").alias("n")
    )
    return _with_share(rows)


def year_weights(
    sales: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR, absent: int = 1, weight: str | None = None
) -> DataFrame:
    """One row per year of the target range; a year without data weighs ``absent``."""
    counts = sales.groupBy("order_year").agg(_amount(weight).alias("_n"))
    years = sales.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("order_year"))
    rows = years.join(counts, "order_year", "left").select(
        "order_year", F.coalesce("_n", F.lit(absent)).cast("bigint").alias("n")
    )
    return _with_share(rows)


def _with_share(rows: DataFrame) -> DataFrame:
    total = rows.agg(F.sum("n")).scalar()
    return rows.withColumn("share", F.col("n").cast("double") / total.cast("double"))


def assign_ids(spark: SparkSession, start: int, n: int) -> DataFrame:
    """``n`` new rows with contiguous ids, without a shuffle."""
    return spark.range(start, start + n).withColumnRenamed("id", "order_id")


def sample_segments(draws: DataFrame, frequency: DataFrame) -> DataFrame:
    return weighted_pick(draws, cumulative_weights(frequency, SEGMENT_KEYS), "segment", SEGMENT_KEYS)


def sample_dates(draws: DataFrame, years: DataFrame, months: DataFrame) -> DataFrame:
    """Year, month and day (1..28), drawn independently."""
    dated = weighted_pick(draws, cumulative_weights(years, ["order_year"]), "year", ["order_year"])
    dated = weighted_pick(dated, cumulative_weights(months, ["order_month"]), "month", ["order_month"])
    day = uniform_int("day", "order_id", 28) + 1
    return dated.withColumn("order_date", F.make_date("order_year", "order_month", day))


def _pick_within(draws: DataFrame, sales: DataFrame, column: str, by, default: str, weight: str | None) -> DataFrame:
    """Pick by the share within the parent; unknown parents draw from all values."""
    if column not in sales.columns:
        return draws.withColumn(column, F.lit(default))
    counts = materialise(value_frequency(sales, [column], by, weight).select(*by, column, "n"))
    picked = weighted_pick(draws, cumulative_weights(counts, [column], by), column, [column], by)
    overall = counts.groupBy(column).agg(F.sum("n").alias("n")).withColumnRenamed(column, "_any")
    spare = weighted_pick(picked, cumulative_weights(overall, ["_any"]), f"any {column}", ["_any"])
    return spare.withColumn(column, F.coalesce(column, "_any", F.lit(default))).drop("_any")


def sample_city(draws: DataFrame, sales: DataFrame, weight: str | None = None) -> DataFrame:
    return _pick_within(draws, sales, "city", ["region"], "Unknown", weight)


def sample_product(draws: DataFrame, sales: DataFrame, weight: str | None = None) -> DataFrame:
    return _pick_within(draws, sales, "product_name", ["category", "sub_category"], "Product", weight)


def sample_payment(draws: DataFrame, sales: DataFrame, weight: str | None = None) -> DataFrame:
    if "payment_mode" not in sales.columns:
        return draws.withColumn("payment_mode", F.lit("Card"))
    counts = value_frequency(sales, ["payment_mode"], weight=weight).select("payment_mode", "n")
    return weighted_pick(draws, cumulative_weights(counts, ["payment_mode"]), "payment", ["payment_mode"])


def sample_names(draws: DataFrame) -> DataFrame:
    def one(names, stream):
        return F.element_at(F.array(*[F.lit(n) for n in names]), uniform_int(stream, "order_id", len(names)) + 1)

    return draws.withColumn("customer_name", F.concat_ws(" ", one(FIRST_NAMES, "first name"), one(LAST_NAMES, "last name")))


def sample_numeric(draws: DataFrame, profile: DataFrame) -> DataFrame:
    """Price, discount and quantity around the segment median, clamped, not redrawn."""
    joined = draws.join(size_checked(profile), list(SEGMENT_KEYS), "left")

    def around(measure: str) -> Column:
        return F.col(f"{measure}_med") + F.col(f"{measure}_scale") * standard_normal(measure, "order_id")

    return joined.select(
        *draws.columns,
        clamp(around("price"), low=1.0).alias("raw_price"),
        clamp(around("disc"), low=0.0, high=MAX_DISCOUNT).alias("raw_discount"),
        clamp(around("qty"), low=1.0).alias("raw_quantity"),
    )


def season_quantity(draws: DataFrame, strength: float = SEASONAL_STRENGTH) -> DataFrame:
    factor = _by_month(F.lit(1.0 + strength / 2), F.lit(1.0 - strength / 3), F.lit(1.0))
    return draws.withColumn("quantity", half_even_int(F.col("raw_quantity") * factor))


def derive_sales(draws: DataFrame) -> DataFrame:
    """Sales from the unrounded price and discount."""
    return draws.withColumn("raw_sales", discounted_sales("raw_price", "quantity", "raw_discount"))


def derive_profit(draws: DataFrame, margins: DataFrame) -> DataFrame:
    """Sales times the category's median margin plus noise, clamped."""
    joined = draws.join(size_checked(margins), "category", "left")
    margin = F.coalesce("median_margin", F.lit(DEFAULT_MARGIN)) + F.lit(MARGIN_NOISE) * standard_normal("margin", "order_id")
    low, high = MARGIN_RANGE
    return joined.withColumn("raw_profit", F.col("raw_sales") * clamp(margin, low, high)).drop("median_margin")


def new_sales(
    sales: DataFrame, counts: DataFrame, draws: DataFrame, *,
    first_year: int, last_year: int, absent_year_weight: int, strength: float,
) -> DataFrame:
    """Fill the drawn ids with every column of a sales row; ``counts`` are the ``key_counts``."""
    rows = sample_segments(draws, value_frequency(stringify_keys(counts), SEGMENT_KEYS, weight="n"))
    years = year_weights(counts, first_year, last_year, absent_year_weight, "n")
    rows = sample_dates(rows, years, month_weights(counts, strength, "n"))
    rows = sample_payment(sample_product(sample_city(rows, counts, "n"), counts, "n"), counts, "n")
    rows = season_quantity(sample_numeric(rows, segment_profile(sales)), strength)
    rows = derive_sales(rows)
    if "profit" in sales.columns and "sales" in sales.columns:
        rows = derive_profit(rows, median_margin_by_category(sales))
    else:
        nothing = sales.sparkSession.createDataFrame([], "category string, median_margin double")
        rows = derive_profit(rows, nothing)
    rounded = {
        "unit_price": half_even("raw_price", 2).cast("decimal(18,2)"),
        "discount": half_even("raw_discount", 2).cast("decimal(5,2)"),
        "sales": half_even("raw_sales", 2).cast("decimal(18,4)"),
        "profit": half_even("raw_profit", 2).cast("decimal(18,4)"),
    }
    return sample_names(rows).select(
        "order_id", "order_date", "customer_name", "region", "city", "category", "sub_category", "product_name",
        "quantity", *[c.alias(n) for n, c in rounded.items()], "payment_mode",
    )


def expand_sales(
    sales: DataFrame,
    target_rows: int = TARGET_ROWS,
    *,
    first_year: int = FIRST_YEAR,
    last_year: int = LAST_YEAR,
    absent_year_weight: int = 1,
    strength: float = SEASONAL_STRENGTH,
    sort: bool = True,
    stored: bool = False,
) -> DataFrame:
    """``sales`` plus drawn rows up to ``target_rows``; unchanged if already there.

    Needs the calendar columns. The input is written once, unless it already is
    a written table (``stored``), and the frequency tables come from one count
    of it. Only the row count and the next id reach the driver.
    """
    sales = drop_incomplete(sales if stored else materialise(sales), EXPANSION_KEYS)
    existing = drop_calendar(sales)
    counts = key_counts(sales)
    missing = max(0, target_rows - (counts.agg(F.sum("n")).first()[0] or 0))
    if missing == 0:
        return existing
    draws = assign_ids(sales.sparkSession, next_order_id(sales).first()["next_order_id"], missing)
    drawn = new_sales(
        sales, counts, draws, first_year=first_year, last_year=last_year, absent_year_weight=absent_year_weight, strength=strength
    )
    out = append_rows(with_optional_columns(existing), drawn)
    return sort_by_date(out) if sort else out


def drop_calendar(sales: DataFrame) -> DataFrame:
    return sales.drop("order_year", "order_month", "order_quarter", "row_key")


def sort_by_date(sales: DataFrame) -> DataFrame:
    """Date order, ties by id, so the sort is spread evenly and repeatable."""
    return sales.orderBy("order_date", "order_id")


def expansion_fidelity(source: DataFrame, generated: DataFrame) -> DataFrame:
    """Shares and quartiles per segment, source beside generated."""

    def summary(sales: DataFrame, side: str) -> DataFrame:
        profile = segment_profile(sales).join(
            segment_frequency(sales).select(*SEGMENT_KEYS, "share"), list(SEGMENT_KEYS), "left"
        )
        names = ["share"] + [f"{m}_{q}" for m in ("price", "disc", "qty") for q in ("q1", "med", "q3")]
        return profile.select(*SEGMENT_KEYS, *[F.col(n).alias(f"{n}_{side}") for n in names])

    return summary(stringify_keys(source), "source").join(
        summary(stringify_keys(generated), "generated"), list(SEGMENT_KEYS), "full"
    )
