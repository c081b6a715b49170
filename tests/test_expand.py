import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.segments import next_order_id
from ledgerloom.plans import expand as ex
from ledgerloom.plans.catalog import expansion
from ledgerloom.sources.sales import CSV_NAMES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def grown(sales):
    target = sales.count() + 2000
    return ex.expand_sales(sales, target).cache(), target


def test_rows_ids_and_ranges(sales, grown):
    out, target = grown
    start = next_order_id(sales).first()[0]
    new = out.where(F.col("order_id") >= start)
    assert out.count() == target and out.columns[: len(CSV_NAMES)] and set(out.columns) == set(CSV_NAMES.values())
    stats = new.agg(
        F.count_distinct("order_id"), F.min("order_id"), F.max("order_id"), F.min("unit_price"), F.min("discount"),
        F.max("discount"), F.min("quantity"), F.min(F.year("order_date")), F.max(F.year("order_date")), F.max(F.day("order_date")),
    ).first()
    assert tuple(stats[:3]) == (2000, start, start + 1999)
    assert stats[3] >= 1 and stats[4] >= 0 and stats[5] <= 60 and stats[6] >= 1
    assert stats[7] >= 2022 and stats[8] <= 2025 and stats[9] <= 28
    assert new.where(" or ".join(f"{c} is null" for c in new.columns)).count() == 0


def test_values_come_from_their_parents(sales, grown):
    new = grown[0].where(F.col("order_id") >= next_order_id(sales).first()[0])
    for keys in (["category", "sub_category", "region"], ["region", "city"], ["category", "sub_category", "product_name"], ["payment_mode"]):
        assert new.join(sales.select(*keys).distinct(), keys, "left_anti").count() == 0
    off = F.abs(F.col("sales") - F.col("unit_price") * F.col("quantity") * (1 - F.col("discount") / 100))
    assert new.where(off > 0.01 * F.col("quantity") + 0.01 * F.col("unit_price") * F.col("quantity")).count() == 0
    margin = F.col("profit") / F.col("sales")
    assert new.where(F.col("sales") > 10).where(~margin.between(0.005, 0.405)).count() == 0


def test_sorted_by_date(grown):
    dates = [r[0] for r in grown[0].select("order_date").collect()]
    assert dates == sorted(dates)


def test_nothing_to_do(sales):
    same = ex.expand_sales(sales, 10)
    assert same.exceptAll(ex.drop_calendar(sales)).count() == 0 and same.count() == sales.count()


def test_optional_columns_may_be_absent(sales):
    small = sales.drop("payment_mode", "profit", "city", "order_id", "product_name")
    out = ex.expand_sales(small, small.count() + 50).where("order_id is not null")
    row = out.agg(F.min("order_id"), F.max("payment_mode"), F.max("city"), F.max("product_name"), F.count("profit")).first()
    assert tuple(row) == (100_000, "Card", "Unknown", "Product", 50)


def test_missing_region_draws_any_city(sales):
    holed = sales.withColumn("region", F.when(F.col("region") != "ASIA", F.col("region")))
    out = ex.expand_sales(holed, holed.count() + 800).where(F.col("order_id") >= next_order_id(sales).first()[0])
    lost = out.where("region = 'nan'")
    assert lost.count() > 50 and lost.where("city is null").count() == 0
    assert lost.select("city").distinct().count() > 10


def test_weights(sales):
    months = {r.order_month: r for r in ex.month_weights(sales.where("order_month <> 5")).collect()}
    counts = {r.order_month: r["count"] for r in sales.groupBy("order_month").count().collect()}
    assert months[5].n == 1000 and months[11].n == 1300 * counts[11] and months[2].n == 850 * counts[2]
    assert sum(m.share for m in months.values()) == pytest.approx(1)
    years = {r.order_year: r.n for r in ex.year_weights(sales, 2000, 2003, absent=9).collect()}
    assert years[2003] == 9 and years[2000] == sales.where("order_year = 2000").count()


def test_numeric_draws_store_every_row_but_only_the_columns_they_read(spark):
    whole = expansion._draws(spark, SMALL)[0]
    kept, draws = expansion._draws(spark, SMALL, *expansion._NUMERIC_COLUMNS)
    assert kept.columns == list(expansion._NUMERIC_COLUMNS) and draws.count() == whole.count()
    assert kept.exceptAll(whole.select(*kept.columns)).count() == whole.select(*kept.columns).exceptAll(kept).count() == 0
