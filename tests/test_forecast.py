import datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import forecasting as fc
from ledgerloom.operators import series as sr
from ledgerloom.plans import forecast as plan

rng = np.random.default_rng(3)
SERIES = {
    "one": [5.0],
    "five": [3.0, 4.0, 8.0, 1.0, 2.0],
    "thirteen": list(np.round(rng.uniform(10, 90, 13), 2)),
    "two years": list(np.round(50 + 20 * np.sin(np.arange(24) * np.pi / 6) + rng.normal(0, 2, 24), 2)),
    "sixty": list(np.round(np.arange(60) + 30 * np.cos(np.arange(60) * np.pi / 6) + rng.normal(0, 3, 60), 2)),
    "constant": [7.0] * 30,
    "zeros": [0.0] * 20,
}


def months(n):
    return [datetime.date(2020 + i // 12, i % 12 + 1, 1) for i in range(n)]


@pytest.fixture(scope="module")
def history(spark):
    rows = [(k, m, float(v)) for k, y in SERIES.items() for m, v in zip(months(len(y)), y)]
    df = spark.createDataFrame(rows, "series_key string, month date, value double")
    df = df.withColumn("value", F.col("value").cast("decimal(18,2)"))
    return sr.histories(df).withColumn("horizon", F.lit(6)).cache()


def paths(df):
    out = {}
    for r in df.orderBy("series_key", "step").collect():
        out.setdefault(r.series_key, []).append(r.value)
    return out


def holt_winters(y, h):
    n = len(y)
    best = None
    for a, b, g in fc.HOLT_WINTERS_GRID:
        if n >= 24:
            level, start = sum(y[:12]) / 12, 12
            trend, ring = (sum(y[12:24]) - sum(y[:12])) / 144, [v - level for v in y[:12]]
        else:
            level, start, ring, g = y[0], 1, [0.0], 0.0
            trend = y[1] - y[0] if n > 1 else 0.0
        sse = 0.0
        for v in y[start:]:
            base, season = level + trend, ring[0]
            sse += (v - base - season) ** 2
            new = a * (v - season) + (1 - a) * base
            trend, level = b * (new - level) + (1 - b) * trend, new
            ring = ring[1:] + [g * (v - level) + (1 - g) * season]
        if best is None or sse < best[0] - 1e-9:
            best = (sse, level, trend, ring)
    return [best[1] + j * best[2] + best[3][(j - 1) % len(best[3])] for j in range(1, h + 1)]


def arima(y, h, d):
    w = np.diff(y) if d else np.array(y)
    if len(w) < 3:
        return [y[-1]] * h
    x, t = w[:-1], w[1:]
    phi = float(((x - x.mean()) * (t - t.mean())).sum() / ((x - x.mean()) ** 2).sum()) if np.ptp(x) else 0.0
    phi = max(-fc.PHI_LIMIT, min(fc.PHI_LIMIT, phi))
    c, out, last, level = t.mean() - phi * x.mean(), [], w[-1], y[-1]
    for _ in range(h):
        last = c + phi * last
        level += last
        out.append(level if d else last)
    return out


def test_holt_winters_equals_a_plain_loop(history):
    got = paths(fc.forecast_holt_winters(history))
    for k, y in SERIES.items():
        np.testing.assert_allclose(got[k], holt_winters(y, 6), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("d", [0, 1])
def test_arima_equals_least_squares(history, d):
    got = paths(fc.forecast_arima(history, 1, d))
    for k, y in SERIES.items():
        np.testing.assert_allclose(got[k], arima(y, 6, d), rtol=1e-6, atol=1e-6)


def _lag_regression(y, horizon, p, d):
    y = np.array(y, float)
    w = np.diff(y) if d else y
    if len(w) < 2 * p + 1:
        return [y[-1]] * horizon
    lags = np.column_stack([np.ones(len(w) - p)] + [w[p - i : len(w) - i] for i in range(1, p + 1)])
    coef = np.linalg.lstsq(lags, w[p:], rcond=None)[0]
    recent, moves = list(w[: -p - 1 : -1]), []
    for _ in range(horizon):
        moves.append(coef[0] + coef[1:] @ recent)
        recent = [moves[-1], *recent[:-1]]
    return list(y[-1] + np.cumsum(moves)) if d else moves


@pytest.mark.parametrize("p", [2, 3, 5])
@pytest.mark.parametrize("d", [0, 1])
def test_high_order_arima_equals_least_squares(spark, p, d):
    rng = np.random.default_rng(p)
    noisy = {f"n{n}": np.round(rng.gamma(2.0, 40.0, n), 2).tolist() for n in (1, 2, 2 * p + d, 2 * p + 1 + d, 30, 200)}
    rows = [(k, [Decimal(str(v)) for v in y], len(y), 6) for k, y in noisy.items()]
    df = spark.createDataFrame(rows, "series_key string, y array<decimal(18,2)>, n int, horizon int")
    got = paths(fc.forecast_arima(df, p, d))
    for k, y in noisy.items():
        np.testing.assert_allclose(got[k], _lag_regression(y, 6, p, d), rtol=1e-6, atol=1e-6, err_msg=k)


def test_lags_that_repeat_earlier_ones_get_no_weight(spark):
    turns = [1.0, -1.0] * 20  # the second lag is the negative of the first
    df = spark.createDataFrame(
        [("flat", [Decimal(7)] * 20, 20, 4), ("turns", [Decimal(int(v)) for v in turns], 40, 4)],
        "series_key string, y array<decimal(18,2)>, n int, horizon int",
    )
    got = paths(fc.forecast_arima(df, 3, 0))
    np.testing.assert_allclose(got["flat"], [7.0] * 4, atol=1e-9)
    np.testing.assert_allclose(got["turns"], [1.0, -1.0, 1.0, -1.0], atol=1e-9)
    with pytest.raises(ValueError):
        fc.forecast_arima(df, 2, 2)


def test_moving_average(history):
    got = paths(fc.forecast_moving_average(history))
    assert got["one"] == [5.0] * 6 and got["five"] == pytest.approx([11 / 3] * 6)


def test_backtest_and_choice(history):
    scores = fc.backtest_mape(history)
    keys = {r.series_key for r in scores.collect()}
    assert keys == set(SERIES) - {"one"}
    zeros = [r.mape for r in scores.collect() if r.series_key == "zeros"]
    assert zeros == [None] * 4
    best = {r.series_key: r for r in fc.select_forecast_model(scores).collect()}
    assert best["constant"].mape == 0.0 and best["constant"].model_name == "arima_110"
    actual = SERIES["sixty"][-12:]
    hw = next(r.mape for r in scores.collect() if r.series_key == "sixty" and r.model_name == "holt_winters")
    want = np.mean([abs(a - f) / abs(a) for a, f in zip(actual, holt_winters(SERIES["sixty"][:-12], 12))]) * 100
    assert hw == pytest.approx(want, abs=0.006)


def test_gaps_are_filled_and_open_months_dropped(spark):
    rows = [("A", "2024-01-15", 5.0), ("A", "2024-04-30", 7.0), ("B", "2024-03-02", 1.0), (None, "2024-03-03", 2.0)]
    df = spark.createDataFrame(rows, "category string, d string, s double").select(
        "category", F.to_date("d").alias("order_date"), F.col("s").cast("decimal(18,4)").alias("sales")
    )
    series = sr.fill_months(sr.monthly_sales_series(df))
    got = {(r.series_key, r.month.month): float(r.value) for r in series.collect()}
    assert got["A", 2] == 0 and got["B", 4] == 0 and got["All", 3] == 3 and ("B", 1) not in got
    assert sr.drop_partial_month(series, df).agg(F.max("month")).first()[0].month == 4
    early = df.where("order_date < '2024-04-01'")
    assert sr.drop_partial_month(series, early).agg(F.max("month")).first()[0].month == 2


def test_status(spark, history):
    asked = spark.createDataFrame([("sixty", 3), ("sixty", 0), ("nothing", 3), ("one", 3)], "series_key string, horizon int")
    got = [(r.series_key, r.horizon, r.error) for r in plan.forecast_status(asked, history).collect()]
    assert set(got) == {
        ("sixty", 3, None), ("sixty", 0, "bad_horizon"), ("nothing", 3, "unknown_category"), ("one", 3, "insufficient_history"),
    }


def test_forecast_sales_shapes(sales):
    out = plan.forecast_sales(sales, 5, "All").collect()
    assert {r.series_key for r in out} == {"All"} and sum(r.kind == "forecast" for r in out) == 5
    with pytest.raises(ValueError):
        plan.forecast_sales(sales, 0)
