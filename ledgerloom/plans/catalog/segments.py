"""Catalog: aggregates and reports over sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.scalars import fixed4
from ledgerloom.operators import segments as sg
from ledgerloom.operators.cleaning import SERVING_KEYS, TRAINING_KEYS, drop_incomplete
from ledgerloom.operators.lookup import segment_profile_with_freq as profile_with_freq
from ledgerloom.operators.sampling import cumulative_weights as weights_of
from ledgerloom.plans.catalog.inputs import sales_table, stored_sales, sql_fixed4, sql_mean, with_sales


def _training(spark, folder):
    return drop_incomplete(sales_table(spark, folder), TRAINING_KEYS)


def _serving(spark, folder):
    return drop_incomplete(sales_table(spark, folder), SERVING_KEYS)


def demand_cells_train(spark, folder):
    return sg.demand_cells_train(_training(spark, folder))


def demand_cells_serve(spark, folder):
    return sg.demand_cells_serve(_serving(spark, folder))


def _quantised(df):
    names = [n for n in df.columns if n.split("_")[-1] in ("med", "q1", "q3", "scale", "margin")]
    return df.withColumns({n: fixed4(n) for n in names})


def segment_profile(spark, folder):
    return _quantised(sg.segment_profile(stored_sales(spark, folder)))


def segment_profile_with_freq(spark, folder):
    sales = stored_sales(spark, folder)
    return _quantised(profile_with_freq(sg.segment_profile(sales), sg.segment_frequency(sales)))


def segment_frequency(spark, folder):
    return sg.segment_frequency(sales_table(spark, folder))


def value_frequency(spark, folder):
    """Months, years, payment modes overall; cities in regions; products in sub-categories."""
    sales = stored_sales(spark, folder)
    parts = []
    for name, column, by in (
        ("month", "order_month", ()),
        ("year", "order_year", ()),
        ("payment", "payment_mode", ()),
        ("city", "city", ("region",)),
        ("product", "product_name", ("category", "sub_category")),
    ):
        counted = sg.value_frequency(sales, [column], by)
        parent = F.concat_ws("/", *by) if by else F.lit("")
        parts.append(
            counted.select(
                F.lit(name).alias("kind"), parent.alias("parent"), F.col(column).cast("string").alias("value"), "n", "share"
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def option_lists(spark, folder):
    return sg.option_lists(_serving(spark, folder))


def subcategories_of(spark, folder):
    return sg.subcategories_of(_serving(spark, folder))


def global_stats(spark, folder):
    return sg.global_stats(_serving(spark, folder))


def segment_stats(spark, folder):
    cells = sg.demand_cells_serve(_serving(spark, folder))
    # Means of doubles depend on the order of addition, so cell means are fixed first.
    cells = cells.withColumns({c: (F.floor(F.col(c) * 1e4 + F.lit(0.5))).cast("decimal(20,0)") for c in ("avg_unit_price", "avg_discount")})
    stats = sg.segment_stats(cells.withColumns({c: F.col(c).cast("double") for c in ("avg_unit_price", "avg_discount")}))
    return stats.withColumns({c: F.col(c) / F.lit(1e4) for c in ("avg_unit_price", "avg_discount")})


def median_margin_by_category(spark, folder):
    return _quantised(sg.median_margin_by_category(stored_sales(spark, folder)))


def latest_period(spark, folder):
    return sg.latest_period(_serving(spark, folder))


def next_order_id(spark, folder):
    return sg.next_order_id(sales_table(spark, folder))


def row_report(spark, folder):
    return sg.row_report(sales_table(spark, folder), 80_000)


def cumulative_weights(spark, folder):
    """Cumulative weights of every product within its category and sub-category."""
    sales = sales_table(spark, folder)
    by = ("category", "sub_category")
    return weights_of(sg.value_frequency(sales, ["product_name"], by), ["product_name"], by)


QUERIES = {
    f.__name__: f
    for f in (
        demand_cells_train, demand_cells_serve, segment_profile, segment_profile_with_freq, segment_frequency,
        value_frequency, option_lists, subcategories_of, global_stats, segment_stats, median_margin_by_category,
        latest_period, next_order_id, row_report, cumulative_weights,
    )
}

_CELL = "order_year, order_month, category, sub_category, region"
_SEG = "category, sub_category, region"

CELLS_SQL = f"""cells as (
  select {_CELL}, {sql_mean('unit_price')} as avg_unit_price, {sql_mean('discount')} as avg_discount,
         count(discount) as orders_count
  from sales group by all
)"""


def _quartiles(column: str, name: str) -> str:
    return ", ".join(
        f"quantile_cont(cast({column} as double), {p}) as {name}_{s}" for s, p in (("med", "5e-1"), ("q1", "25e-2"), ("q3", "75e-2"))
    )


PROFILE_SQL = f"""raw_profile as (
  select {_SEG}, {_quartiles('unit_price', 'price')}, {_quartiles('discount', 'disc')}, {_quartiles('quantity', 'qty')},
         quantile_cont(cast(sales as double), 5e-1) as sales_med, cast(count(*) as int) as n
  from sales group by all
), profile as (
  select *, {", ".join(
      f"case when {m}_q3 - {m}_q1 > 1e-9 then {m}_q3 - {m}_q1 else greatest({m}_q3 * 1e-1, 1e0) end as {m}_scale"
      for m in ("price", "disc", "qty"))}
  from raw_profile
)"""
_PROFILE_COLUMNS = [f"{m}_{s}" for m in ("price", "disc", "qty") for s in ("med", "q1", "q3")]
_PROFILE_COLUMNS += ["sales_med", "price_scale", "disc_scale", "qty_scale"]
_PROFILE_LIST = ", ".join(f"{sql_fixed4(c)} as {c}" for c in _PROFILE_COLUMNS)


def _frequency(kind: str, column: str, by: str) -> str:
    parent = by.replace(", ", " || '/' || ") if by else "''"
    partition = f"partition by {by}" if by else ""
    group = f"{by}, {column}" if by else column
    return f"""select '{kind}' as kind, {parent} as parent, cast({column} as varchar) as value, count(*) as n,
      cast(count(*) as double) / cast(sum(count(*)) over ({partition}) as double) as share
      from sales group by {group}"""


PRODUCT_WEIGHTS_SQL = """product_weights as (
  select category, sub_category, product_name, count(*) as n,
         cast(sum(count(*)) over (partition by category, sub_category order by substr(md5(product_name), 1, 2), product_name
              rows unbounded preceding) as bigint) as hi,
         cast(sum(count(*)) over (partition by category, sub_category) as bigint) as total,
         count(*) over (partition by category, sub_category) as outcomes
  from sales group by category, sub_category, product_name
)"""

ORACLES = {
    "demand_cells_train": with_sales(
        f"""select {_CELL}, cast(sum(quantity) as bigint) as total_quantity, {sql_mean('unit_price')} as avg_unit_price,
            {sql_mean('discount')} as avg_discount, count(quantity) as orders_count from sales group by all"""
    ),
    "demand_cells_serve": with_sales(CELLS_SQL, "select * from cells"),
    "segment_profile": with_sales(PROFILE_SQL, f"select {_SEG}, {_PROFILE_LIST} from profile"),
    "segment_profile_with_freq": with_sales(PROFILE_SQL, f"select {_SEG}, {_PROFILE_LIST}, n from profile"),
    "segment_frequency": with_sales(
        f"""select {_SEG}, count(*) as n, cast(count(*) as double) / cast(sum(count(*)) over () as double) as share
            from sales group by {_SEG}"""
    ),
    "value_frequency": with_sales(
        " union all ".join(
            [
                _frequency("month", "order_month", ""),
                _frequency("year", "order_year", ""),
                _frequency("payment", "payment_mode", ""),
                _frequency("city", "city", "region"),
                _frequency("product", "product_name", "category, sub_category"),
            ]
        )
    ),
    "option_lists": with_sales(
        """select distinct 'category' as option, category as value from sales
           union all select distinct 'sub_category', sub_category from sales
           union all select distinct 'region', region from sales
           union all select distinct 'city', city from sales
           union all select distinct 'year', cast(order_year as varchar) from sales
           union all select 'month', lpad(cast(m as varchar), 2, '0') from range(1, 13) t(m)"""
    ),
    "subcategories_of": with_sales("select distinct category, sub_category from sales"),
    "global_stats": with_sales(
        f"""select {sql_mean('unit_price')} as avg_unit_price, {sql_mean('discount')} as avg_discount,
            count(*) as orders_count from sales"""
    ),
    "segment_stats": with_sales(
        CELLS_SQL,
        f"""select {_SEG},
            cast(sum(cast(floor(avg_unit_price * 1e4 + 5e-1) as bigint)) as double) / count(*) / 1e4 as avg_unit_price,
            cast(sum(cast(floor(avg_discount * 1e4 + 5e-1) as bigint)) as double) / count(*) / 1e4 as avg_discount,
            cast(trunc(avg(orders_count)) as bigint) as orders_count from cells group by {_SEG}""",
    ),
    "median_margin_by_category": with_sales(
        f"""select category, {sql_fixed4('quantile_cont(cast(profit as double) / cast(sales as double), 5e-1)')} as median_margin
            from sales where sales > 0 and profit is not null group by category"""
    ),
    "latest_period": with_sales(
        """select max(order_date) as latest_date, cast(year(max(order_date)) as int) as order_year,
           cast(month(max(order_date)) as int) as order_month,
           cast((month(max(order_date)) - 1) // 3 + 1 as int) as order_quarter from sales"""
    ),
    "next_order_id": with_sales("select cast(coalesce(max(order_id) + 1, 100000) as bigint) as next_order_id from sales"),
    "row_report": with_sales(
        """select count(*) as rows_before, cast(greatest(0, 80000 - count(*)) as bigint) as rows_to_add,
           cast(count(*) + greatest(0, 80000 - count(*)) as bigint) as rows_after from sales"""
    ),
    "cumulative_weights": with_sales(
        PRODUCT_WEIGHTS_SQL,
        "select category, sub_category, product_name, n, hi - n as lo, hi, total, outcomes from product_weights",
    ),
}
