import datetime
import math

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as sc
from ledgerloom.operators import cleaning as cl
from ledgerloom.session import scratch_path
from ledgerloom.sources import sales as src


def test_dirty_csv(spark, tmp_path):
    (tmp_path / "sales.csv").write_text(
        "Order ID,Order Date,Region,City,Category,Sub-Category,Quantity,Unit Price,Discount,Sales\n"
        "1,2024-03-01,East,Xi,Chairs,Stool,2,10.50,5,19.95\n"
        "2,03/04/2024,East,NA,Chairs,Stool,abc,10.50,,n/a\n"
        "3,nonsense,,Xi,Chairs,Stool,3.0,NaN, 7.5 ,1e2\n"
    )
    rows = src.read_sales(spark, str(tmp_path / "sales.csv")).orderBy("order_id").collect()
    assert rows[0]["order_date"] == datetime.date(2024, 3, 1) and float(rows[0]["sales"]) == 19.95
    assert rows[1]["order_date"] == datetime.date(2024, 3, 4)
    assert (rows[1]["city"], rows[1]["quantity"], rows[1]["discount"], rows[1]["sales"]) == (None,) * 4
    assert (rows[2]["order_date"], rows[2]["region"], rows[2]["unit_price"]) == (None,) * 3
    assert (rows[2]["quantity"], float(rows[2]["discount"]), float(rows[2]["sales"])) == (3, 7.5, 100.0)


def test_write_then_read(spark, sales):
    path = scratch_path(spark, "round-trip")
    src.write_sales(sales, path)
    back = src.read_sales(spark, path)
    columns = [c for c in src.FIELD_TYPES]
    assert back.select(*columns).exceptAll(sales.select(*columns)).count() == 0
    assert back.count() == sales.count()


def test_column_report_lists_absent_columns(spark):
    df = spark.createDataFrame([("a", None)], "region string, city string")
    report = {r["column_name"]: (r["missing"], r["filled_rows"]) for r in src.column_report(df).collect()}
    assert report["region"] == (False, 1) and report["city"] == (False, 0)
    assert report["profit"] == (True, 0) and len(report) == len(src.REQUIRED_COLUMNS)


def test_optional_columns_are_typed_nulls(spark):
    df = src.with_optional_columns(spark.createDataFrame([("a",)], "region string"))
    assert dict(df.dtypes)["quantity"] == "decimal(18,4)" and df.first()["payment_mode"] is None


def test_numbers(spark):
    texts = ["3", " 3 ", "3.5", "1e3", "abc", "NaN", "inf", "", None, "12d", "-.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(sc.parse_number("t"), sc.parse_integer("t")).collect()]
    assert [g[0] for g in got] == [3.0, 3.0, 3.5, 1000.0, None, None, None, None, None, None, -0.5]
    assert [g[1] for g in got] == [3, 3] + [None] * 9


def test_rounding_clamping_and_nan(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (float("nan"),), (None,)], "x double")
    row = df.where("not isnan(x) and x is not null").select(sc.half_even_int("x")).collect()
    assert [r[0] for r in row] == [0, 2, 2, 0]
    assert [r[0] for r in df.select(sc.clamp("x", 0.0, 2.0)).collect()][:4] == [0.5, 1.5, 2.0, 0.0]
    assert df.select(sc.clamp("x", 0.0, 2.0)).collect()[5][0] is None
    assert df.select(F.avg(sc.nan_to_null("x"))).first()[0] == 1.0
    assert math.isnan(df.select(F.avg("x")).first()[0])
    assert df.where("false").select(sc.mean_of("x")).first()[0] is None


def test_key_sets_and_segments(spark):
    df = spark.createDataFrame([(None, "s", "r"), ("c", "s", "r")], "category string, sub_category string, region string")
    assert cl.drop_incomplete(df, cl.TRAINING_KEYS).count() == 1
    assert cl.stringify_keys(df).where("category = 'nan'").count() == 1
    assert cl.filter_segment(df, category="c", region="r").count() == 1
    assert cl.filter_segment(df).count() == 2


def test_append_fills_absent_columns(spark):
    both = cl.append_rows(spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3,)], "a int"))
    assert sorted(tuple(r) for r in both.collect()) == sorted([(1, 2), (3, None)])
