"""Catalog: sources, cleaning and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.scalars import parse_date
from ledgerloom.operators import cleaning as cl
from ledgerloom.plans.catalog.inputs import CLEAN_SQL, dirty_text, sales_table, with_sales
from ledgerloom.session import materialise, scratch_path
from ledgerloom.sources import sales as src

_MEASURES = ("unit_price", "discount", "sales", "profit")


def _plain(df):
    """Decimals as double, the common type of both engines."""
    return df.withColumns({c: F.col(c).cast("double") for c in _MEASURES if c in df.columns})


def _typed(spark, folder):
    return src.typed_sales(dirty_text(sales_table(spark, folder)))


def read_sales(spark, folder):
    """Write the dirty table as CSV to the shared folder, then read it like a user file."""
    path = scratch_path(spark, "dirty-sales")
    headers = {field: header for header, field in src.CSV_NAMES.items()}
    dirty = dirty_text(sales_table(spark, folder))
    dirty.toDF(*[headers.get(c, c) for c in dirty.columns]).write.option("header", True).csv(path)
    return _plain(src.read_sales(spark, path)).withColumn("quantity", F.col("quantity").cast("double"))


def write_sales(spark, folder):
    path = scratch_path(spark, "sales")
    src.write_sales(sales_table(spark, folder), path)
    back = src.read_sales(spark, path)
    return back.groupBy("category", F.year("order_date").alias("order_year")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("quantity").cast("bigint").alias("quantity"),
        F.sum("sales").cast("double").alias("sales"),
        F.sum("profit").cast("double").alias("profit"),
    )


def column_report(spark, folder):
    return src.column_report(_typed(spark, folder))


def parse_dates(spark, folder):
    dirty = dirty_text(sales_table(spark, folder))
    return dirty.select("row_key", parse_date("order_date").alias("order_date"))


def coerce_numeric(spark, folder):
    dirty = dirty_text(sales_table(spark, folder))
    return cl.coerce_numeric(dirty).select("row_key", *cl.NUMERIC_COLUMNS)


def drop_incomplete(spark, folder):
    typed = materialise(_typed(spark, folder))
    kept = [
        cl.drop_incomplete(typed, keys).select(F.lit(name).alias("key_set"), "row_key")
        for name, keys in (("serving", cl.SERVING_KEYS), ("training", cl.TRAINING_KEYS), ("expansion", cl.EXPANSION_KEYS))
    ]
    return kept[0].union(kept[1]).union(kept[2])


def calendar_features(spark, folder):
    return sales_table(spark, folder).select("row_key", "order_year", "order_month", "order_quarter")


def project_features(spark, folder):
    return _plain(cl.project_features(sales_table(spark, folder)))


def filter_segment(spark, folder):
    found = cl.filter_segment(sales_table(spark, folder), category="PROMO", region="ASIA", year=1998)
    return _plain(found.select("row_key", "category", "sub_category", "region", "order_year", "sales"))


def append_rows(spark, folder):
    """Clean rows first, then the dirty copy, which has fewer columns."""
    sales = sales_table(spark, folder).drop("order_year", "order_month", "order_quarter")
    both = cl.append_rows(sales, _typed(spark, folder))
    return both.groupBy("category", "payment_mode").agg(
        F.count(F.lit(1)).alias("rows"), F.count("order_date").alias("dated"), F.sum("quantity").cast("bigint").alias("quantity")
    )


QUERIES = {
    f.__name__: f
    for f in (
        read_sales, write_sales, column_report, parse_dates, coerce_numeric, drop_incomplete,
        calendar_features, project_features, filter_segment, append_rows,
    )
}

_COLUMNS = "row_key, order_date, region, city, category, sub_category, quantity"
_DOUBLES = ", ".join(f"cast({c} as double) as {c}" for c in _MEASURES)
_FILLED = """select '{0}' as column_name, {1} as missing, cast({2} as bigint) as filled_rows from typed"""
_PRESENT = ("order_date", "region", "city", "category", "sub_category", "quantity", *_MEASURES)

ORACLES = {
    "read_sales": with_sales(
        CLEAN_SQL, f"select {_COLUMNS.removesuffix(', quantity')}, cast(quantity as double) as quantity, {_DOUBLES} from typed"
    ),
    "write_sales": with_sales(
        """select category, cast(year(order_date) as int) as order_year, count(*) as rows,
           cast(sum(quantity) as bigint) as quantity, cast(sum(sales) as double) as sales,
           cast(sum(profit) as double) as profit from sales group by all"""
    ),
    "column_report": with_sales(
        CLEAN_SQL,
        " union all ".join(
            _FILLED.format(c, "false" if c in _PRESENT else "true", f"count({c})" if c in _PRESENT else "0 * count(*)")
            for c in src.REQUIRED_COLUMNS
        ),
    ),
    "parse_dates": with_sales(CLEAN_SQL, "select row_key, order_date from typed"),
    "coerce_numeric": with_sales(
        CLEAN_SQL,
        f"""select row_key, cast(quantity as double) as quantity, cast(unit_price as double) as unit_price,
            cast(discount as double) as discount, cast(sales as double) as sales, cast(profit as double) as profit from typed""",
    ),
    "drop_incomplete": with_sales(
        CLEAN_SQL,
        " union all ".join(
            f"select '{name}' as key_set, row_key from typed where " + " and ".join(f"{k} is not null" for k in keys)
            for name, keys in (("serving", cl.SERVING_KEYS), ("training", cl.TRAINING_KEYS), ("expansion", cl.EXPANSION_KEYS))
        ),
    ),
    "calendar_features": with_sales("select row_key, order_year, order_month, order_quarter from sales"),
    "project_features": with_sales(
        """select row_key, region, city, category, sub_category, quantity, cast(unit_price as double) as unit_price,
           cast(discount as double) as discount, cast(sales as double) as sales, order_year, order_month, order_quarter
           from sales"""
    ),
    "filter_segment": with_sales(
        """select row_key, category, sub_category, region, order_year, cast(sales as double) as sales from sales
           where category = 'PROMO' and region = 'ASIA' and order_year = 1998"""
    ),
    "append_rows": with_sales(
        CLEAN_SQL,
        """select category, payment_mode, count(*) as rows, count(order_date) as dated, cast(sum(quantity) as bigint) as quantity
           from (select category, payment_mode, order_date, quantity from sales
                 union all select category, null, order_date, quantity from typed) group by all""",
    ),
}
