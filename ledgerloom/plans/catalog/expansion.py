"""Catalog: weighted sampling and table expansion."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ledgerloom.functions.scalars import fixed4
from ledgerloom.operators import segments as sg
from ledgerloom.operators.cleaning import SEGMENT_KEYS
from ledgerloom.operators.sampling import cumulative_weights, weighted_pick as pick
from ledgerloom.plans import expand as ex
from ledgerloom.plans.catalog.inputs import sales_table, stored_sales, sql_fixed4, sql_uniform, sql_uniform_int, with_sales
from ledgerloom.plans.catalog.segments import PROFILE_SQL
from ledgerloom.session import materialise

YEARS = (1999, 2003)  # three years with data, two without
_SEG = "category, sub_category, region"


def _draws(spark, folder, *columns):
    """(sales, as many new ids as the table has rows)."""
    sales = stored_sales(spark, folder, *columns)
    start = sg.next_order_id(sales).first()["next_order_id"]
    return sales, ex.assign_ids(spark, start, sales.count())


_LINE = (
    "order_id", "order_date", "customer_name", "region", "city", "category", "sub_category", "product_name", "quantity",
    "unit_price", "discount", "sales", "profit", "payment_mode",
)


def _expanded(spark, folder):
    sales = stored_sales(spark, folder, *_LINE, "order_year", "order_month")
    return sales, ex.expand_sales(
        sales, sales.count() * 3 // 2, first_year=YEARS[0], last_year=YEARS[1], stored=True
    )


def month_weights(spark, folder):
    return ex.month_weights(sales_table(spark, folder))


def year_weights(spark, folder):
    return ex.year_weights(sales_table(spark, folder), *YEARS)


def weighted_pick(spark, folder):
    """Each order line draws a product of its own category and sub-category."""
    sales = sales_table(spark, folder)
    by = ("category", "sub_category")
    dist = cumulative_weights(sg.value_frequency(sales, ["product_name"], by), ["product_name"], by)
    return pick(sales.select("row_key", *by), dist, "pick", ["product_name"], by, row_id="row_key")


def assign_ids(spark, folder):
    return _draws(spark, folder)[1]


def sample_segments(spark, folder):
    sales, draws = _draws(spark, folder)
    return ex.sample_segments(draws, sg.segment_frequency(sales))


def sample_dates(spark, folder):
    sales, draws = _draws(spark, folder)
    return ex.sample_dates(draws, ex.year_weights(sales, *YEARS), ex.month_weights(sales))


def sample_city(spark, folder):
    sales, draws = _draws(spark, folder)
    return ex.sample_city(ex.sample_segments(draws, sg.segment_frequency(sales)), sales)


def sample_product(spark, folder):
    sales, draws = _draws(spark, folder)
    return ex.sample_product(ex.sample_segments(draws, sg.segment_frequency(sales)), sales)


def sample_payment(spark, folder):
    sales, draws = _draws(spark, folder)
    return ex.sample_payment(draws, sales)


def sample_names(spark, folder):
    return ex.sample_names(_draws(spark, folder)[1])


_NUMERIC_COLUMNS = (
    "order_id", *SEGMENT_KEYS, "order_year", "order_month", "unit_price", "discount", "quantity", "sales", "profit",
)


def _numeric(spark, folder):
    sales, draws = _draws(spark, folder, *_NUMERIC_COLUMNS)
    rows = ex.sample_segments(draws, sg.segment_frequency(sales))
    rows = ex.sample_dates(rows, ex.year_weights(sales, *YEARS), ex.month_weights(sales))
    return sales, ex.sample_numeric(rows, sg.segment_profile(sales))


def sample_numeric(spark, folder):
    rows = _numeric(spark, folder)[1]
    return rows.select("order_id", *[fixed4(c).alias(c) for c in ("raw_price", "raw_discount", "raw_quantity")])


def season_quantity(spark, folder):
    return ex.season_quantity(_numeric(spark, folder)[1]).select("order_id", "order_month", "quantity")


def derive_sales(spark, folder):
    rows = ex.derive_sales(ex.season_quantity(_numeric(spark, folder)[1]))
    return rows.select("order_id", fixed4("raw_sales").alias("raw_sales"))


def derive_profit(spark, folder):
    sales, rows = _numeric(spark, folder)
    rows = ex.derive_sales(ex.season_quantity(rows))
    rows = ex.derive_profit(rows, sg.median_margin_by_category(sales))
    return rows.select("order_id", fixed4("raw_profit").alias("raw_profit"))


def expand_sales(spark, folder):
    out = _expanded(spark, folder)[1]
    return out.withColumns({c: F.col(c).cast("double") for c in ("unit_price", "discount", "sales", "profit")})


def expansion_fidelity(spark, folder):
    sales, out = _expanded(spark, folder)
    first_new = sg.next_order_id(sales).scalar()
    compared = ex.expansion_fidelity(sales, materialise(out.where(F.col("order_id") >= first_new)))
    measured = [c for c in compared.columns if c.split("_")[0] in ("price", "disc", "qty")]
    return compared.withColumns({c: fixed4(c) for c in measured})


QUERIES = {
    f.__name__: f
    for f in (
        month_weights, year_weights, weighted_pick, assign_ids, sample_segments, sample_dates, sample_city, sample_product,
        sample_payment, sample_names, sample_numeric, season_quantity, derive_sales, derive_profit, expand_sales,
        expansion_fidelity,
    )
}


def _weights(name: str, columns: str, source: str, by: str = "") -> str:
    """CTE with [lo, hi) per value, buckets first."""
    part = f"partition by {by}" if by else ""
    text = "concat_ws('|', " + columns + ")"
    return f"""{name} as (
  select *, hi - n as lo from (
    select *, cast(sum(n) over ({part} order by substr(md5({text}), 1, 2), {columns} rows unbounded preceding) as bigint) as hi,
           cast(sum(n) over ({part}) as bigint) as total
    from ({source}))
)"""


def _pick(name: str, draws: str, dist: str, stream: str, columns: str, by: str = "", row_id: str = "order_id") -> str:
    """CTEs: draws with the value whose weight range their position falls in."""
    keys = [k.strip() for k in by.split(",") if k.strip()]
    totals = f"(select {', '.join([*keys, 'any_value(total) as total'])} from {dist} {'group by ' + by if by else ''})"
    on = " and ".join(f"d.{k} = s.{k}" for k in keys) or "true"
    same = "".join(f"a.{k} = w.{k} and " for k in keys)
    taken = ", ".join(f"w.{c.strip()}" for c in columns.split(","))
    return f"""{name}_at as (
  select d.*, cast(floor({sql_uniform(stream, 'd.' + row_id)} * cast(s.total as double)) as bigint) as pos
  from {draws} d join {totals} s on {on}
), {name} as (
  select a.* exclude (pos), {taken} from {name}_at a asof join {dist} w on {same}a.pos >= w.lo
)"""


def _normal(stream: str) -> str:
    return (
        f"(sqrt(-2e0 * ln({sql_uniform(stream + '.r', 'order_id')}))"
        f" * cos({2 * math.pi!r}e0 * {sql_uniform(stream + '.a', 'order_id')}))"
    )


MONTHS_SQL = """months as (
  select cast(m as int) as order_month,
         cast(coalesce(c, 1) * case when m in (11, 12) then 1300 when m in (2, 3) then 850 else 1000 end as bigint) as n
  from range(1, 13) t(m) left join (select order_month as om, count(*) as c from sales group by om) on om = m
)"""
YEARS_SQL = f"""years as (
  select cast(y as int) as order_year, cast(coalesce(c, 1) as bigint) as n
  from range({YEARS[0]}, {YEARS[1] + 1}) t(y) left join (select order_year as oy, count(*) as c from sales group by oy) on oy = y
)"""
SHARE = "cast(n as double) / cast(sum(n) over () as double) as share"


def _ids(count: str) -> str:
    return f"""draws as (
  select (select max(order_id) + 1 from sales) + i as order_id from range((select {count} from sales)) t(i)
)"""


IDS_SQL = _ids("count(*)")
SEGMENTS_SQL = (
    _weights("segment_weights", _SEG, f"select {_SEG}, count(*) as n from sales group by all")
    + ", "
    + _pick("with_segment", "draws", "segment_weights", "segment", _SEG)
)


def _dates(draws: str) -> str:
    parts = [
        YEARS_SQL,
        MONTHS_SQL,
        _weights("year_w", "order_year", "select * from years"),
        _weights("month_w", "order_month", "select * from months"),
        _pick("with_year", draws, "year_w", "year", "order_year"),
        _pick("with_month", "with_year", "month_w", "month", "order_month"),
        f"""with_date as (
  select *, make_date(order_year, order_month, {sql_uniform_int('day', 'order_id', 28)} + 1) as order_date from with_month
)""",
    ]
    return ",\n".join(parts)


CITY_SQL = _weights("city_w", "city", "select region, city, count(*) as n from sales group by all", "region")
PRODUCT_SQL = _weights(
    "product_w",
    "product_name",
    "select category, sub_category, product_name, count(*) as n from sales group by all",
    "category, sub_category",
)
PAYMENT_SQL = _weights("payment_w", "payment_mode", "select payment_mode, count(*) as n from sales group by all")
_BY_PRODUCT = "category, sub_category"


def _name(names, stream: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"([{listed}])[{sql_uniform_int(stream, 'order_id', len(names))} + 1]"


NAME_SQL = f"{_name(ex.FIRST_NAMES, 'first name')} || ' ' || {_name(ex.LAST_NAMES, 'last name')} as customer_name"


def _numeric_sql(draws: str) -> str:
    return f"""numeric_rows as (
  select d.*, greatest(1e0, price_med + price_scale * {_normal('price')}) as raw_price,
         greatest(0e0, least(60e0, disc_med + disc_scale * {_normal('disc')})) as raw_discount,
         greatest(1e0, qty_med + qty_scale * {_normal('qty')}) as raw_quantity
  from {draws} d join profile p on p.category = d.category and p.sub_category = d.sub_category and p.region = d.region
), with_quantity as (
  select *, cast(round_even(raw_quantity * case when order_month in (11, 12) then 115e-2 when order_month in (2, 3) then 9e-1
                 else 1e0 end, 0) as bigint) as quantity
  from numeric_rows
), with_sales_value as (
  select *, raw_price * quantity * (1e0 - raw_discount / 1e2) as raw_sales from with_quantity
), margins as (
  select category as margin_category, quantile_cont(cast(profit as double) / cast(sales as double), 5e-1) as median_margin
  from sales where sales > 0 and profit is not null group by category
), with_profit as (
  select *, raw_sales * greatest(1e-2, least(4e-1, median_margin + 4e-2 * {_normal('margin')})) as raw_profit
  from with_sales_value join margins on category = margin_category
)"""


_NUMERIC = (IDS_SQL, SEGMENTS_SQL, _dates("with_segment"), PROFILE_SQL, _numeric_sql("with_date"))


def _rounded(x: str) -> str:
    return f"cast(round_even({x}, 2) as decimal(18,2))"


EXPANDED_SQL = ",\n".join(
    [
        _ids("count(*) * 3 // 2 - count(*)"),
        SEGMENTS_SQL,
        _dates("with_segment"),
        CITY_SQL,
        _pick("with_city", "with_date", "city_w", "city", "city", "region"),
        PRODUCT_SQL,
        _pick("with_product", "with_city", "product_w", "product_name", "product_name", _BY_PRODUCT),
        PAYMENT_SQL,
        _pick("with_payment", "with_product", "payment_w", "payment", "payment_mode"),
        PROFILE_SQL,
        _numeric_sql("with_payment"),
        f"""drawn as (
  select order_id, order_date, {NAME_SQL}, region, city, category, sub_category, product_name, quantity,
         cast({_rounded('raw_price')} as double) as unit_price, cast({_rounded('raw_discount')} as double) as discount,
         cast({_rounded('raw_sales')} as double) as sales, cast({_rounded('raw_profit')} as double) as profit, payment_mode
  from with_profit
)""",
    ]
)
_SALE = """order_id, order_date, customer_name, region, city, category, sub_category, product_name, quantity,
  cast(unit_price as double) as unit_price, cast(discount as double) as discount, cast(sales as double) as sales,
  cast(profit as double) as profit, payment_mode"""


def _side(source: str, side: str) -> str:
    quartiles = ", ".join(
        sql_fixed4(f"quantile_cont(cast({c} as double), {p})") + f" as {m}_{q}_{side}"
        for m, c in (("price", "unit_price"), ("disc", "discount"), ("qty", "quantity"))
        for q, p in (("q1", "25e-2"), ("med", "5e-1"), ("q3", "75e-2"))
    )
    return f"""select {_SEG}, cast(count(*) as double) / cast(sum(count(*)) over () as double) as share_{side}, {quartiles}
      from {source} group by {_SEG}"""


ORACLES = {
    "month_weights": with_sales(MONTHS_SQL, f"select order_month, n, {SHARE} from months"),
    "year_weights": with_sales(YEARS_SQL, f"select order_year, n, {SHARE} from years"),
    "weighted_pick": with_sales(
        PRODUCT_SQL,
        "draws as (select row_key, category, sub_category from sales)",
        _pick("picked", "draws", "product_w", "pick", "product_name", _BY_PRODUCT, "row_key"),
        "select * from picked",
    ),
    "assign_ids": with_sales(IDS_SQL, "select * from draws"),
    "sample_segments": with_sales(IDS_SQL, SEGMENTS_SQL, "select * from with_segment"),
    "sample_dates": with_sales(IDS_SQL, _dates("draws"), "select * from with_date"),
    "sample_city": with_sales(
        IDS_SQL, SEGMENTS_SQL, CITY_SQL, _pick("picked", "with_segment", "city_w", "city", "city", "region"), "select * from picked"
    ),
    "sample_product": with_sales(
        IDS_SQL,
        SEGMENTS_SQL,
        PRODUCT_SQL,
        _pick("picked", "with_segment", "product_w", "product_name", "product_name", _BY_PRODUCT),
        "select * from picked",
    ),
    "sample_payment": with_sales(
        IDS_SQL, PAYMENT_SQL, _pick("picked", "draws", "payment_w", "payment", "payment_mode"), "select * from picked"
    ),
    "sample_names": with_sales(IDS_SQL, f"select order_id, {NAME_SQL} from draws"),
    "sample_numeric": with_sales(
        *_NUMERIC,
        "select order_id, "
        + ", ".join(f"{sql_fixed4(c)} as {c}" for c in ("raw_price", "raw_discount", "raw_quantity"))
        + " from numeric_rows",
    ),
    "season_quantity": with_sales(*_NUMERIC, "select order_id, order_month, quantity from with_quantity"),
    "derive_sales": with_sales(*_NUMERIC, f"select order_id, {sql_fixed4('raw_sales')} as raw_sales from with_sales_value"),
    "derive_profit": with_sales(*_NUMERIC, f"select order_id, {sql_fixed4('raw_profit')} as raw_profit from with_profit"),
    "expand_sales": with_sales(EXPANDED_SQL, f"select {_SALE} from sales union all select {_SALE} from drawn"),
    "expansion_fidelity": with_sales(
        EXPANDED_SQL,
        f"""select * from ({_side('sales', 'source')}) full join ({_side('drawn', 'generated')}) using ({_SEG})""",
    ),
}
