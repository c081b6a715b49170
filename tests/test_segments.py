import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import quantiles as qt
from ledgerloom.operators import segments as sg

SCHEMA = (
    "order_year int, order_month int, category string, sub_category string, region string, "
    "unit_price decimal(18,2), discount decimal(5,2), quantity bigint, sales decimal(18,4), profit decimal(18,4)"
)


def frame(spark, rows):
    from decimal import Decimal

    def dec(x):
        return None if x is None else Decimal(str(x))

    return spark.createDataFrame([(*r[:5], dec(r[5]), dec(r[6]), r[7], dec(r[8]), dec(r[9])) for r in rows], SCHEMA)


ROWS = [
    (2024, 1, "A", "x", "N", 10, 5, 2, 19, 3),
    (2024, 1, "A", "x", "N", 20, None, 3, 60, 6),
    (2024, 2, "A", "x", "N", 30, 15, 1, 25, 5),
    (2024, 2, None, "x", "N", 99, 15, 1, 25, None),
]


def test_cells_skip_null_keys_and_null_values(spark):
    df = frame(spark, ROWS)
    train = {(r.order_year, r.order_month): r for r in sg.demand_cells_train(df).collect()}
    serve = {(r.order_year, r.order_month): r for r in sg.demand_cells_serve(df).collect()}
    assert len(train) == len(serve) == 2
    assert (train[2024, 1].total_quantity, train[2024, 1].orders_count, train[2024, 1].avg_discount) == (5, 2, 5.0)
    assert serve[2024, 1].orders_count == 1  # counts discounts, not quantities


def test_segment_mean_is_a_mean_of_cells(spark):
    cells = sg.demand_cells_serve(frame(spark, ROWS))
    plain = sg.segment_stats(cells).first()
    assert (plain.avg_unit_price, plain.orders_count) == ((15 + 30) / 2, 1)
    three = cells.withColumn("orders_count", F.when(F.col("order_month") == 1, 4).otherwise(1).cast("bigint"))
    assert sg.segment_stats(three).first().orders_count == 2  # 2.5 truncated
    assert sg.segment_stats(three, weighted=True).first().avg_unit_price == pytest.approx((15 * 4 + 30) / 5)


def test_profile_scales(spark):
    profile = {r.category: r for r in sg.segment_profile(frame(spark, ROWS)).collect()}
    assert set(profile) == {"A", "nan"}
    assert (profile["A"].price_q1, profile["A"].price_med, profile["A"].price_q3, profile["A"].price_scale) == (15, 20, 25, 10)
    assert profile["nan"].price_scale == pytest.approx(9.9)  # one row: a tenth of the quartile
    assert profile["nan"].qty_scale == 1.0  # and at least one
    no_sales = sg.segment_profile(frame(spark, ROWS).drop("sales")).where("category = 'A'").first()
    assert no_sales.sales_med == 20


def test_frequency_shares(spark):
    freq = sg.segment_frequency(frame(spark, ROWS)).collect()
    assert sum(r.share for r in freq) == 1.0 and max(r.n for r in freq) == 3
    within = sg.value_frequency(frame(spark, ROWS), ["order_month"], ["category"]).collect()
    assert {(r.order_month, r.share) for r in within} == {(1, 2 / 3), (2, 1 / 3)}


def test_reports(spark):
    df = frame(spark, ROWS)
    assert sg.next_order_id(df).first()[0] == 100_000
    assert sg.next_order_id(df.withColumn("order_id", F.lit(41).cast("bigint"))).first()[0] == 42
    assert tuple(sg.row_report(df, 10).first()) == (4, 6, 10)
    assert tuple(sg.row_report(df, 2).first()) == (4, 0, 4)
    dated = df.withColumn("order_date", F.lit(datetime.date(2024, 12, 5)))
    assert tuple(sg.latest_period(dated).first()) == (datetime.date(2024, 12, 5), 2024, 12, 4)
    assert sg.median_margin_by_category(df).collect()[0].median_margin == pytest.approx(3 / 19)


def _check_quantiles(spark, held, bins, sizes=(1, 2, 7, 400, 6000)):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    for size in sizes:
        smooth, lumpy = rng.lognormal(3, 2, size), rng.integers(0, 4, size).astype(float)
        rows += [(size, float(a), float(b)) for a, b in zip(smooth, lumpy)]
        want[size, "a"], want[size, "b"] = np.quantile(smooth, probs), np.quantile(lumpy, probs)
    df = spark.createDataFrame(rows, "k int, a double, b double").repartition(5)
    got = qt.exact_quantiles(df, ["k"], {"a": F.col("a"), "b": F.col("b")}, probs, held, bins).collect()
    assert len(got) == 2 * len(sizes)
    for r in got:
        np.testing.assert_allclose(r.q, want[r.k, r.measure], rtol=1e-12)


def test_quantiles_whole_groups(spark):
    _check_quantiles(spark, 10_000, 4_096)


def test_quantiles_by_brackets(spark):
    _check_quantiles(spark, 500, 64)


def test_quantiles_narrowed_to_single_values(spark):
    _check_quantiles(spark, 1, 5, sizes=(3, 700))


def test_quantiles_of_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.col("id") * F.lit(0.125) + F.pow(F.lit(1.00002), F.col("id"))).alias("x"))
    x = np.arange(1_000_000) * 0.125 + np.power(1.00002, np.arange(1_000_000))
    (got,) = qt.exact_quantiles(df, ["k"], {"x": F.col("x")}, (0.1, 0.5, 0.99)).collect()
    np.testing.assert_allclose(got.q, np.quantile(x, (0.1, 0.5, 0.99)), rtol=1e-9)


def test_quantiles_of_wide_ranges_and_ends_without_number(spark):
    rows = [1e308, -1e308, 0.0, 1e-300, 2e-300, 3e-300, float("inf"), float("-inf"), 5.0, 5.0, 5.0]
    df = spark.createDataFrame([("k", v) for v in rows] + [("z", None)], "k string, x double")
    (got,) = qt.exact_quantiles(df, ["k"], {"x": F.col("x")}, (0.1, 0.2, 0.3, 0.4, 0.5, 0.9), 1, 2).collect()
    assert got.q == [sorted(rows)[i] for i in (1, 2, 3, 4, 5, 9)]


def test_values_are_counted_by_a_bracket_number_alone(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(50)] + [("b", float(i)) for i in range(9)], "k string, x double")
    found = qt.exact_quantiles(df, ["k"], {"x": F.col("x")}, (0.25, 0.5))
    plan = found._jdf.queryExecution().toString()
    assert "bracket" in plan and not any("value" in line and "below" in line for line in plan.splitlines() if "HashAggregate" in line)
    assert {r["k"]: list(r["q"]) for r in found.collect()} == {"a": [1.0, 3.0], "b": [2.0, 4.0]}
