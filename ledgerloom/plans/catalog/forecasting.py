"""Catalog: monthly series, forecasters, model choice."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.draws import uniform_int
from ledgerloom.operators import forecasting as fc
from ledgerloom.operators import series as sr
from ledgerloom.plans import forecast as plan
from ledgerloom.plans.catalog.inputs import sales_table, sql_uniform_int, with_sales
from ledgerloom.sources.requests import REJECTIONS, parse_requests

HORIZON = 12
HIGH_ORDERS = (2, 3)


def _series(spark, folder):
    return sr.fill_months(sr.monthly_sales_series(sales_table(spark, folder)))


def _history(spark, folder):
    history = plan.series_histories(sales_table(spark, folder), drop_partial=True)
    return history.withColumn("horizon", F.lit(HORIZON))


def _as_double(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def monthly_sales_series(spark, folder):
    return _as_double(sr.monthly_sales_series(sales_table(spark, folder)), "value")


def fill_months(spark, folder):
    return _as_double(_series(spark, folder), "value")


def series_lag(spark, folder):
    return _as_double(sr.series_lag(_series(spark, folder)), "value", "previous", "difference")


def moving_average(spark, folder):
    return _as_double(sr.moving_average(_series(spark, folder)), "value")


def forecast_moving_average(spark, folder):
    return fc.forecast_moving_average(_history(spark, folder))


def forecast_holt_winters(spark, folder):
    return fc.forecast_holt_winters(_history(spark, folder))


def forecast_arima(spark, folder):
    history = _history(spark, folder)
    parts = [fc.forecast_arima(history, 1, d).withColumn("d", F.lit(d)) for d in (0, 1)]
    return parts[0].unionByName(parts[1])


def forecast_arima_high_order(spark, folder):
    """ARIMA(2,d,0) and ARIMA(3,d,0) for d of 0 and 1."""
    history = _history(spark, folder)
    parts = [
        fc.forecast_arima(history, p, d).withColumns({"p": F.lit(p), "d": F.lit(d)}) for p, d in product(HIGH_ORDERS, (0, 1))
    ]
    return reduce(DataFrame.unionByName, parts)


def backtest_mape(spark, folder):
    return fc.backtest_mape(_history(spark, folder)).drop("model_rank")


def select_forecast_model(spark, folder):
    return fc.select_forecast_model(fc.backtest_mape(_history(spark, folder)))


def forecast_sales(spark, folder):
    return plan.forecast_sales(sales_table(spark, folder), HORIZON, drop_partial=True)


def forecast_frame(spark, folder):
    return plan.forecast_frame(plan.forecast_sales(sales_table(spark, folder), HORIZON, drop_partial=True))


def forecast_status(spark, folder):
    """One forecast request per order line: categories, unknown names, bad horizons."""
    sales = sales_table(spark, folder)
    slot = uniform_int("status", "row_key", 4)
    requests = sales.select(
        F.col("row_key").alias("request_id"),
        F.when(slot == 0, F.lit("All")).when(slot == 1, F.col("product_name")).otherwise(F.col("category")).alias("series_key"),
        F.when(slot == 2, F.lit(0)).otherwise(F.col("quantity").cast("int")).alias("horizon"),
    )
    return plan.forecast_status(requests, plan.series_histories(sales, drop_partial=True))


ASKED = (3, 12, 0)  # horizons asked for, per category


def answer_forecasts(spark, folder):
    """Answers to requests for every category, the total, an unknown name and broken JSON."""
    sales = sales_table(spark, folder)
    names = sales.select("category").distinct().union(spark.sql("select * from values ('All'), ('nobody')"))
    payload = F.to_json(F.struct(F.col("h").alias("horizon"), "category"))
    asked = names.withColumn("h", F.explode(F.array(*[F.lit(h) for h in ASKED]))).select(
        F.concat_ws("/", "category", "h").alias("request_id"), payload.alias("payload")
    )
    broken = asked.select(F.concat(F.lit("broken "), "request_id").alias("request_id"), F.expr("left(payload, length(payload) - 1)").alias("payload"))
    parsed = parse_requests(asked.union(broken), "forecast")
    answers = plan.answer_forecasts(parsed, sales, drop_partial=True)
    told = F.from_json(
        "response",
        "error string, model_name string, mape double, history struct<dates:array<string>,values:array<double>>, "
        "forecast struct<dates:array<string>,values:array<double>>",
    )
    size = F.size(F.coalesce("a.forecast.values", F.array().cast("array<double>")))
    return answers.withColumn("a", told).select(
        "request_id", "a.error", "a.model_name", "a.mape", size.alias("n_ahead"),
        F.element_at("a.history.dates", -1).alias("last_month"),
        F.floor(F.element_at("a.forecast.values", -1) / 100).cast("double").alias("last_hundreds"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        monthly_sales_series, fill_months, series_lag, moving_average, forecast_moving_average, forecast_holt_winters,
        forecast_arima, forecast_arima_high_order, backtest_mape, select_forecast_model, forecast_sales, forecast_frame,
        forecast_status, answer_forecasts,
    )
}

SERIES_SQL = """cells_by_month as (
  select cast(date_trunc('month', order_date) as date) as month, category as series_key, sum(sales) as value
  from sales group by all
), monthly as (
  select series_key, month, cast(value as decimal(18,2)) as value from cells_by_month
  union all
  select 'All', month, cast(sum(value) as decimal(18,2)) from cells_by_month group by month
)"""


def _filled(name: str, source: str) -> str:
    return f"""{name} as (
  select a.series_key, a.month, coalesce(m.value, cast(0 as decimal(18,2))) as value
  from (select series_key, cast(unnest(generate_series(cast(min(month) as timestamp),
               (select cast(max(month) as timestamp) from {source}), interval 1 month)) as date) as month
        from {source} group by series_key) a
  left join {source} m on a.series_key = m.series_key and a.month = m.month
)"""


FILLED_SQL = _filled("filled", "monthly")

# History without the open last month; positions count from 1.
HISTORY_SQL = (
    """closed as (
  select * from monthly where month < (
    select case when max(order_date) < last_day(max(order_date)) then date_trunc('month', max(order_date))
                else date_trunc('month', max(order_date)) + interval 1 month end from sales)
), """
    + _filled("history", "closed")
    + """, placed as (
  select series_key, month, value, cast(row_number() over (partition by series_key order by month) as int) as t,
         cast(count(*) over (partition by series_key) as int) as n
  from history
)"""
)


def _fit_sql(tag: str, known: str, horizon: str) -> str:
    """CTEs fitting all four models on the first ``known`` points; result ``paths_<tag>``."""
    grid = ", ".join(f"({i}, {a}e0, {b}e0, {g}e0)" for i, (a, b, g) in enumerate(fc.HOLT_WINTERS_GRID))
    s = f"""y_{tag} as (
  select series_key, month, value, t, {known} as n, {horizon} as h from placed where t <= {known} and {horizon} >= 1
), size_{tag} as (
  select series_key, any_value(n) as n, any_value(h) as h, max(month) as last_month,
         cast(max_by(value, t) as double) as last_y from y_{tag} group by series_key
), steps_{tag} as (
  select series_key, n, h, last_y, cast(unnest(range(1, h + 1)) as int) as step from size_{tag}
), ma_{tag} as (
  select y.series_key, cast(sum(value) as double) / least(3, any_value(n)) as mean
  from y_{tag} y where t > n - 3 group by y.series_key
), grid_{tag}(i, a, b, g) as (values {grid}
), hw0_{tag} as (
  select series_key, any_value(n) as n, any_value(n) >= 24 as seasonal,
         cast(sum(value) filter (t <= 12) as double) as y1,
         cast(sum(value) filter (t between 13 and 24) as double) as y2,
         cast(max(value) filter (t = 1) as double) as f1, cast(max(value) filter (t = 2) as double) as f2
  from y_{tag} group by series_key
), hw1_{tag} as (
  select series_key, n, seasonal, case when seasonal then y1 / 12e0 else f1 end as level,
         case when seasonal then (y2 - y1) / 144e0 when n >= 2 then f2 - f1 else 0e0 end as trend,
         case when seasonal then 12 else 1 end as t
  from hw0_{tag}
), ring_{tag} as (
  select w.series_key, list(cast(y.value as double) - w.level order by y.t) as ring
  from hw1_{tag} w join y_{tag} y on y.series_key = w.series_key and y.t <= 12 where w.seasonal group by w.series_key
), hw_{tag} as (
  select w.series_key, w.n, w.seasonal, w.t, g.i, g.a, g.b, case when w.seasonal then g.g else 0e0 end as g,
         w.level, w.trend, coalesce(r.ring, [0e0]) as ring, 0e0 as sse
  from hw1_{tag} w left join ring_{tag} r on r.series_key = w.series_key, grid_{tag} g
  union all
  select series_key, n, seasonal, t, i, a, b, g, level2,
         b * (level2 - level) + (1e0 - b) * trend,
         list_append(ring[2:], g * (v - level2) + (1e0 - g) * ring[1]),
         sse + err * err
  from (select p.*, cast(y.value as double) as v, cast(y.value as double) - ((p.level + p.trend) + p.ring[1]) as err,
               p.a * (cast(y.value as double) - p.ring[1]) + (1e0 - p.a) * (p.level + p.trend) as level2
        from (select series_key, n, seasonal, t + 1 as t, i, a, b, g, level, trend, ring, sse from hw_{tag} where t < n) p
        join y_{tag} y on y.series_key = p.series_key and y.t = p.t)
), hwbest_{tag} as (
  select * from hw_{tag} where t = n qualify row_number() over (partition by series_key order by sse, i) = 1
)"""
    for d in (0, 1):
        w = "value" if d == 0 else "value - lag(value) over (partition by series_key order by t)"
        s += f""", w{d}_{tag} as (
  select series_key, t, n, cast({w} as decimal(18,2)) as w from y_{tag}
), p{d}_{tag} as (
  select series_key, t, w, lag(w) over (partition by series_key order by t) as x from w{d}_{tag}
), f{d}_{tag} as (
  select series_key, cast(count(x) as double) as m, cast(sum(x) as double) as sx, cast(sum(w) filter (x is not null) as double) as st,
         cast(sum(cast(x as decimal(30,2)) * x) as double) as sxx, cast(sum(cast(x as decimal(30,2)) * w) as double) as sxt, cast(max_by(w, t) as double) as last_w
  from p{d}_{tag} group by series_key
), s{d}_{tag} as (
  select *, greatest(-{fc.PHI_LIMIT}e0, least({fc.PHI_LIMIT}e0,
         case when m * sxx - sx * sx > 0 then (m * sxt - sx * st) / (m * sxx - sx * sx) else 0e0 end)) as phi
  from f{d}_{tag}
), ar{d}_{tag} as (
  select f.series_key, z.h, 0 as step, (f.st - f.phi * f.sx) / f.m as c, f.phi, f.last_w as w, z.last_y as y
  from s{d}_{tag} f join size_{tag} z on z.series_key = f.series_key where f.m >= 2
  union all
  select series_key, h, step + 1, c, phi, c + phi * w, {"c + phi * w" if d == 0 else "y + (c + phi * w)"}
  from ar{d}_{tag} where step < h
)"""
    return s + f""", paths_{tag} as (
  select series_key, 0 as model_rank, 'arima_110' as model_name, step, y as value from ar1_{tag} where step > 0
  union all
  select series_key, 1, 'arima_100', step, y from ar0_{tag} where step > 0
  union all
  select s.series_key, 2, 'holt_winters', s.step,
         b.level + cast(s.step as double) * b.trend + b.ring[(s.step - 1) % len(b.ring) + 1]
  from steps_{tag} s join hwbest_{tag} b on b.series_key = s.series_key
  union all
  select s.series_key, 3, 'moving_average', s.step, m.mean from steps_{tag} s join ma_{tag} m on m.series_key = s.series_key
)"""


def _lags_sql(p: int, d: int) -> str:
    """CTEs that fit ARIMA(p,d,0) on the whole history by elimination; result ``path_<p><d>``."""
    tag, lags = f"{p}{d}", range(1, p + 1)
    value = "value" if d == 0 else "value - lag(value) over (partition by series_key order by t)"
    columns = (*lags, 0)
    pairs = [(i, j) for i in lags for j in columns]
    s = f"""w_{tag} as (
  select series_key, t, n, cast({value} as decimal(18,2)) as x0 from placed
), x_{tag} as (
  select series_key, t, n, x0, {", ".join(f"lag(x0, {i}) over (partition by series_key order by t) as x{i}" for i in lags)} from w_{tag}
), last_{tag} as (
  select series_key, any_value(n) as n, [{", ".join(f"cast(max(x0) filter (t = n - {i - 1}) as double)" for i in lags)}] as recent
  from x_{tag} group by series_key
), g_{tag} as (
  select series_key, cast(count(*) as double) as m, {", ".join(f"cast(sum(x{i}) as double) as s{i}" for i in (0, *lags))},
         {", ".join(f"cast(sum(cast(x{i} as decimal(30,2)) * x{j}) as double) as g{i}_{j}" for i, j in pairs)}
  from x_{tag} where x{p} is not null and x0 is not null group by series_key
), e0_{tag} as (
  select g.series_key, m, {", ".join(f"s{i}" for i in (0, *lags))}, {", ".join(f"m * g{i}_{j} - s{i} * s{j} as a{i}_{j}" for i, j in pairs)},
         {", ".join(f"m * g{i}_{i} - s{i} * s{i} as d{i}" for i in lags)}
  from g_{tag} g
)"""
    for k in lags:
        clear = f"a{k}_{k} > {fc.PIVOT_LEAST!r} * d{k}"
        cells = [
            f"case when {clear} then a{i}_{j} else 0e0 end as a{i}_{j}" if i == k
            else f"case when {clear} then a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} else a{i}_{j} end as a{i}_{j}"
            for i, j in pairs
        ]
        s += f""", e{k}_{tag} as (
  select series_key, m, {", ".join(f"s{i}" for i in (0, *lags))}, {", ".join(f"d{i}" for i in lags)}, {", ".join(cells)} from e{k - 1}_{tag}
)"""
    phi = [f"case when a{i}_{i} > 0 then a{i}_0 / a{i}_{i} else 0e0 end as phi{i}" for i in lags]
    rest, move = "s0", "c"
    for i in lags:
        rest, move = f"({rest} - phi{i} * s{i})", f"({move} + phi{i} * recent[{i}])"
    return s + f""", phi_{tag} as (
  select series_key, m, {", ".join(f"s{i}" for i in (0, *lags))}, {", ".join(phi)} from e{p}_{tag}
), go_{tag} as (
  select l.series_key, 0 as step, l.recent, f.m, {rest} / m as c, {", ".join(f"phi{i}" for i in lags)}, z.last_y as y
  from phi_{tag} f join last_{tag} l on l.series_key = f.series_key join size_full z on z.series_key = f.series_key
  where l.n - {d} >= {2 * p + 1}
  union all
  select series_key, step + 1, list_prepend(move, recent[:{p - 1}]), m, c, {", ".join(f"phi{i}" for i in lags)}, {"move" if d == 0 else "y + move"}
  from (select *, {move} as move from go_{tag} where step < {HORIZON})
), path_{tag} as (
  select series_key, step, y as value, {p} as p, {d} as d from go_{tag} where step > 0
  union all
  select series_key, step, last_y, {p}, {d} from steps_full where n - {d} < {2 * p + 1}
)"""


FULL_SQL = _fit_sql("full", "n", str(HORIZON))
HOLDOUT = f"cast(least({fc.MAX_HOLDOUT}, n // 5) as int)"
BACKTEST_SQL = _fit_sql("test", f"n - {HOLDOUT}", HOLDOUT) + f""", scores as (
  select p.series_key, p.model_rank, p.model_name,
         cast(floor(cast(sum(cast(floor(abs(cast(a.value as double) - p.value) / abs(cast(a.value as double)) * 1e8 + 5e-1) as bigint))
              as double) / count(*) / 1e6 * 100 + 5e-1) as double) / 1e2 as mape
  from paths_test p join placed a on a.series_key = p.series_key and a.t = a.n - {HOLDOUT.replace("n //", "a.n //")} + p.step
  where a.value <> 0 group by all
), chosen as (
  select series_key, model_name, mape from scores
  qualify row_number() over (partition by series_key order by mape, model_rank) = 1
)"""
FORECAST_SQL = f"""forecast as (
  select p.series_key, p.month, 'history' as kind, cast(p.value as double) as value, c.model_name, c.mape
  from placed p join chosen c on c.series_key = p.series_key
  union all
  select f.series_key, cast(z.last_month + to_months(f.step) as date), 'forecast', f.value, c.model_name, c.mape
  from paths_full f join chosen c on c.series_key = f.series_key and c.model_name = f.model_name
  join size_full z on z.series_key = f.series_key
)"""
_BASE = (SERIES_SQL, HISTORY_SQL)
_slot = sql_uniform_int("status", "row_key", 4)

ORACLES = {
    "monthly_sales_series": with_sales(SERIES_SQL, "select series_key, month, cast(value as double) as value from monthly"),
    "fill_months": with_sales(SERIES_SQL, FILLED_SQL, "select series_key, month, cast(value as double) as value from filled"),
    "series_lag": with_sales(
        SERIES_SQL,
        FILLED_SQL,
        """select series_key, month, cast(value as double) as value, cast(lag(value) over w as double) as previous,
           cast(value - lag(value) over w as double) as difference from filled window w as (partition by series_key order by month)""",
    ),
    "moving_average": with_sales(
        SERIES_SQL,
        FILLED_SQL,
        """select series_key, month, cast(value as double) as value,
           cast(sum(value) over w as double) / count(*) over w as moving_average
           from filled window w as (partition by series_key order by month rows between 2 preceding and current row)""",
    ),
    "forecast_moving_average": with_sales(
        *_BASE, FULL_SQL, "select series_key, step, value from paths_full where model_name = 'moving_average'"
    ),
    "forecast_holt_winters": with_sales(
        *_BASE, FULL_SQL, "select series_key, step, value from paths_full where model_name = 'holt_winters'"
    ),
    "forecast_arima": with_sales(
        *_BASE,
        FULL_SQL,
        """select series_key, step, value, cast(case model_name when 'arima_110' then 1 else 0 end as int) as d
           from paths_full where model_name like 'arima%'""",
    ),
    "forecast_arima_high_order": with_sales(
        *_BASE,
        FULL_SQL,
        *[_lags_sql(p, d) for p, d in product(HIGH_ORDERS, (0, 1))],
        " union all ".join(
            f"select series_key, cast(step as int) as step, value, cast(p as int) as p, cast(d as int) as d from path_{p}{d}"
            for p, d in product(HIGH_ORDERS, (0, 1))
        ),
    ),
    "backtest_mape": with_sales(*_BASE, BACKTEST_SQL, "select series_key, model_name, mape from scores"),
    "select_forecast_model": with_sales(*_BASE, BACKTEST_SQL, "select * from chosen"),
    "forecast_sales": with_sales(*_BASE, BACKTEST_SQL, FULL_SQL, FORECAST_SQL, "select * from forecast"),
    "forecast_frame": with_sales(
        *_BASE,
        BACKTEST_SQL,
        FULL_SQL,
        FORECAST_SQL,
        """select series_key, month, case when kind = 'history' then value end as history_value,
           case when kind = 'forecast' or month = max(month) filter (kind = 'history') over (partition by series_key)
                then value end as forecast_value from forecast""",
    ),
    "forecast_status": with_sales(
        *_BASE,
        f"""requests as (
          select row_key as request_id, case {_slot} when 0 then 'All' when 1 then product_name else category end as series_key,
                 case when {_slot} = 2 then 0 else cast(quantity as int) end as horizon from sales)""",
        """select r.request_id, r.series_key, r.horizon,
           case when r.horizon < 1 then 'bad_horizon' when p.n is null then 'unknown_category'
                when p.n < 5 then 'insufficient_history' end as error
           from requests r left join (select series_key, any_value(n) as n from placed group by series_key) p using (series_key)""",
    ),
    "answer_forecasts": with_sales(
        *_BASE,
        BACKTEST_SQL,
        FULL_SQL,
        FORECAST_SQL,
        f"""asked as (
          select name, h from (select distinct category as name from sales union all select unnest(['All', 'nobody'])),
                 (select unnest({list(ASKED)}) as h)
        ), steps as (
          select series_key, value, cast(row_number() over (partition by series_key order by month) as int) as step
          from forecast where kind = 'forecast'
        ), past as (
          select series_key, strftime(max(month), '%Y-%m') as last_month from forecast where kind = 'history' group by series_key
        )""",
        f"""select name || '/' || h as request_id,
           case when h < 1 then 'bad_horizon' when c.series_key is null then 'unknown_category' end as error,
           case when h >= 1 then c.model_name end as model_name, case when h >= 1 then c.mape end as mape,
           cast(case when h >= 1 and c.series_key is not null then h else 0 end as int) as n_ahead,
           case when h >= 1 then p.last_month end as last_month,
           cast(floor(round(s.value, 2) / 100) as double) as last_hundreds
           from asked left join chosen c on c.series_key = name left join past p on p.series_key = name
           left join steps s on s.series_key = name and s.step = h
           union all
           select 'broken ' || name || '/' || h, '{REJECTIONS["forecast"]}', null, null, 0, null, null from asked""",
    ),
}
