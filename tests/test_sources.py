"""CSV dialect, lenient dates, request JSON and forecast answers on awkward input."""

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import features as ft
from ledgerloom.operators.cleaning import calendar_features
from ledgerloom.operators.neighbours import knn_join
from ledgerloom.plans import expand as ex
from ledgerloom.plans import forecast as plan
from ledgerloom.sources import requests as rq
from ledgerloom.sources import sales as src

HEAD = "Order ID,Order Date,Region,City,Category,Sub-Category,Product Name,Quantity,Unit Price,Discount,Sales\n"
LINES = [
    '1,2024-01-05,East,Boston,Tech,Screens,"Monitor 24"" wide, black",2.5,10.555,5.125,1234.5',
    '2,2024-01-05T10:00:00,East,Boston,Tech,Screens,"two\nlines",1,9,1234.5,8',
    '3,"Jan 5, 2024",East,Boston,Tech,Screens,x,3.0,9,0,27',
    "4,2024-01-05 10:00:00.123,East,Boston,Tech,Screens,x,abc,9,0,27",
    "5,5 Feb 2024,East,Boston,Tech,Screens,x,1,9,0,9",
    "6,someday,East,Boston,Tech,Screens,x,1,9,0,9",
]


def test_quotes_breaks_fractions_and_dates(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "\n".join(LINES) + "\n")
    rows = {r.order_id: r for r in src.read_sales(spark, str(tmp_path)).collect()}
    assert rows[1].product_name == 'Monitor 24" wide, black' and rows[2].product_name == "two\nlines"
    assert (rows[1].quantity, rows[1].unit_price, rows[1].discount) == (Decimal("2.5"), Decimal("10.555"), Decimal("5.125"))
    assert rows[2].discount == Decimal("1234.5") and rows[4].quantity is None
    day = datetime.date(2024, 1, 5)
    assert [rows[i].order_date for i in range(1, 7)] == [day] * 4 + [datetime.date(2024, 2, 5), None]
    own = src.read_sales(spark, str(tmp_path), date_formats=["d MMM yyyy"]).collect()
    assert sum(r.order_date is not None for r in own) == 1
    lost = {r.column_name: (r.filled, r.lost) for r in src.conversion_losses(src.raw_sales(spark, str(tmp_path))).collect()}
    assert lost["order_date"] == (6, 1) and lost["quantity"] == (6, 1) and lost["unit_price"] == (6, 0)


def test_written_quotes_come_back(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', "x\ny"), ("\\", "")], "product_name string, city string")
    src.write_sales(df, str(tmp_path / "out"))
    got = {tuple(r) for r in src.raw_sales(spark, str(tmp_path / "out")).select("product_name", "city").collect()}
    assert got == {('a "b", c', "x\ny"), ("\\", None)} or got == {('a "b", c', "x\ny"), ("\\", "")}


def test_another_column_order_is_no_silent_shift(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Order ID,Region,City\n1,East,Boston\n")
    (tmp_path / "b.csv").write_text("Order ID,City,Region\n2,Boston,East\n")
    with pytest.raises(Exception, match="(?i)header"):
        src.read_sales(spark, str(tmp_path)).collect()


def test_revenue_training_set_from_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "\n".join([*LINES, LINES[4], LINES[4]]) + "\n")
    sales = calendar_features(src.read_sales(spark, str(tmp_path)))
    keys = [r.row_key for r in ft.training_set(sales, ft.SALES).collect()]
    assert len(keys) == len(set(keys)) == 8
    assert sorted(keys) == sorted(r.row_key for r in ft.training_set(sales.repartition(3), ft.SALES).collect())


def test_broken_null_and_absent_forecast_fields(spark):
    texts = {
        "{}": (12, "All", True), '{"horizon": 5, "category": "X"}': (5, "X", True), '{"horizon": 5, "category": "X"': (None, None, False),
        "{broken": (None, None, False), '{"horizon": null}': (None, None, False), '{"category": null}': (None, None, False),
        "[1]": (None, None, False), "": (None, None, False), '{"horizon": "x"}': (None, None, False),
    }
    parsed = rq.parse_requests(spark.createDataFrame([(t,) for t in texts] + [(None,)], "payload string"), "forecast")
    for r in parsed.collect():
        horizon, category, good = texts.get(r.payload, (None, None, False))
        assert (r.error is None) == good, r
        if good:
            assert (r.horizon, r.category) == (horizon, category)


@pytest.fixture(scope="module")
def short(spark):
    """Series of 1, 4, 5 and 24 months, and one that bears the total's name."""
    rows = [(f"m{n}", f"2023-{m % 12 + 1:02d}-15" if m < 12 else f"2024-{m % 12 + 1:02d}-15", 10.0 * m + n) for n in (24,) for m in range(24)]
    rows += [(f"m{n}", f"2024-{12 - m:02d}-15", 5.0 + m) for n in (1, 4, 5) for m in range(n)] + [("All", "2024-12-03", 1.0)]
    return spark.createDataFrame(rows, "category string, d string, s double").select(
        "category", F.to_date("d").alias("order_date"), F.col("s").cast("decimal(18,4)").alias("sales")
    )


def test_short_series_stay(short):
    out = plan.forecast_sales(short, 3).collect()
    ahead = {k: sum(r.kind == "forecast" for r in out if r.series_key == k) for k in {r.series_key for r in out}}
    assert ahead == {k: 3 for k in ("m1", "m4", "m5", "m24", "All", "'All'")}
    total = [r.value for r in out if r.series_key == "All" and r.kind == "history"]
    assert sum(total) == sum(float(r.sales) for r in short.collect())


def test_forecast_answers(spark, short):
    payloads = [("a", "{}"), ("b", '{"horizon": 2, "category": "m24"}'), ("c", '{"horizon": 0}'), ("d", '{"category": "nope"}'),
                ("e", "{bad"), ("f", '{"category": "m4"}'), ("g", '{"horizon": 2, "category": "m24"}'), ("h", '{"category": "m5", "horizon": 1}')]
    parsed = rq.parse_requests(spark.createDataFrame(payloads, "request_id string, payload string"), "forecast")
    got = {r.request_id: json.loads(r.response) for r in plan.answer_forecasts(parsed, short).collect()}
    assert set(got) == set("abcdefgh")
    assert got["c"] == {"error": "bad_horizon"} and got["d"] == {"error": "unknown_category"} and got["f"] == {"error": "insufficient_history"}
    assert got["e"] == {"error": rq.REJECTIONS["forecast"]}
    assert len(got["a"]["forecast"]["values"]) == 12 and got["b"] == got["g"]
    assert got["b"]["forecast"]["dates"] == ["2025-01", "2025-02"] and len(got["b"]["history"]["dates"]) == 24
    assert len(got["h"]["forecast"]["values"]) == 1


def test_probes_that_share_a_key_keep_their_places(spark):
    schema = "row_key string, x double, label double"
    refs = spark.createDataFrame([(f"r{i}", float(i), float(i)) for i in range(20)], schema)
    probes = spark.createDataFrame([("p", 1.0, 0.0), ("p", 18.0, 0.0), (None, 10.0, 0.0)], schema)
    got = [(r.row_key, r.place, r.label) for r in knn_join(probes, refs, 3, [], ["x"]).collect()]
    assert len(got) == 9 and sorted(v for k, _, v in got if k == "p" ) == [0.0, 1.0, 2.0, 17.0, 18.0, 19.0]
    assert sorted(v for k, _, v in got if k is None) == [9.0, 10.0, 11.0]


def test_parents_without_known_values_fall_back(spark):
    rows = [(i, "E", None) for i in range(40)] + [(100 + i, "W", "Paris") for i in range(40)]
    sales = spark.createDataFrame(rows, "order_id bigint, region string, city string")
    draws = sales.select("order_id", "region")
    got = ex.sample_city(draws, sales).groupBy("region").agg(F.collect_set("city").alias("c")).collect()
    assert {r.region: r.c for r in got} == {"E": ["Paris"], "W": ["Paris"]}
