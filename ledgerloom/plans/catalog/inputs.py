"""Inputs shared by the catalog: the sales table, dirty copies of it, requests.

The oracle texts mirror the same inputs as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.draws import uniform_int
from ledgerloom.operators.cleaning import calendar_features
from ledgerloom.session import materialise, tune
from ledgerloom.sources.sales import star_sales

SALES_SQL = """sales as (
  select l_orderkey as order_id,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   cast(l_quantity as decimal(12,2)), cast(l_extendedprice as decimal(12,2))) as row_key,
         cast(o_orderdate as date) as order_date,
         c_name as customer_name, r_name as region, n_name as city,
         p_type as category, p_brand as sub_category, p_name as product_name,
         cast(l_quantity as bigint) as quantity,
         cast(cast(cast(floor(l_extendedprice / l_quantity * 100 + 5e-1) as bigint) as decimal(14,0))
              * cast(0.01 as decimal(3,2)) as decimal(18,2)) as unit_price,
         cast(l_discount * 100 as decimal(5,2)) as discount,
         cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(18,4)) as sales,
         cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))
              - cast(l_quantity as decimal(5,0)) * cast(p_retailprice as decimal(12,2)) as decimal(18,4)) as profit,
         o_orderpriority as payment_mode,
         cast(year(o_orderdate) as int) as order_year,
         cast(month(o_orderdate) as int) as order_month,
         cast(quarter(o_orderdate) as int) as order_quarter
  from lineitem
  join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey
  join part on l_partkey = p_partkey
)"""


def sales_table(spark: SparkSession, folder: str) -> DataFrame:
    return calendar_features(star_sales(tune(spark), folder))


def stored_sales(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The flat table written once, for jobs that pass over it several times: all rows, with the columns named or all."""
    sales = sales_table(spark, folder)
    return materialise(sales.select(*columns) if columns else sales)


def with_sales(*parts: str) -> str:
    """A query text over the sales view: CTEs, then the final select."""
    *ctes, final = parts
    return "with recursive " + ",\n".join([SALES_SQL, *ctes]) + "\n" + final


def sql_uniform(stream: str, row_id: str) -> str:
    return (
        f"((cast(cast('0x' || substr(md5('{stream}|' || cast({row_id} as varchar)), 1, 12) as bigint) as double)"
        f" + 5e-1) / cast(281474976710656 as double))"
    )


def sql_uniform_int(stream: str, row_id: str, n: int) -> str:
    return f"cast(floor({sql_uniform(stream, row_id)} * {n}e0) as int)"


def sql_fixed4(x: str) -> str:
    return f"(cast(cast(floor(({x}) * 1e4 + 5e-1) as bigint) as double) / 1e4)"


def sql_mean(x: str) -> str:
    return f"cast(sum({x}) as double) / count({x})"


def dirty_text(sales: DataFrame) -> DataFrame:
    """The sales table as raw text with bad dates, gaps and non-numbers."""
    slot = uniform_int("dirt", "row_key", 8)
    text = {c: F.col(c).cast("string") for c in ("quantity", "unit_price", "discount", "sales", "profit")}
    return sales.withColumn("slot", slot).select(
        "row_key",
        F.when(F.col("slot") == 0, "not a date")
        .when(F.col("slot") == 1, "NA")
        .when(F.col("slot") == 2, F.date_format("order_date", "M/d/yyyy"))
        .when(F.col("slot") == 3, F.date_format("order_date", "yyyy/MM/dd"))
        .when(F.col("slot") == 4, F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format("order_date", "yyyy-MM-dd"))
        .alias("order_date"),
        "region",
        F.when(F.col("slot") != 6, F.col("city")).alias("city"),
        "category",
        "sub_category",
        F.when(F.col("slot") == 3, "abc").otherwise(text["quantity"]).alias("quantity"),
        F.when(F.col("slot") == 4, "NaN").otherwise(text["unit_price"]).alias("unit_price"),
        F.when(F.col("slot") == 5, F.concat(F.lit(" "), text["discount"], F.lit(" "))).otherwise(text["discount"]).alias("discount"),
        F.when(F.col("slot") == 7, "n/a").otherwise(text["sales"]).alias("sales"),
        text["profit"].alias("profit"),
    )


# What the dirty copy must come out as: the typed value, or NULL where it was spoiled.
CLEAN_SQL = f"""slotted as (
  select *, {sql_uniform_int("dirt", "row_key", 8)} as slot from sales
), typed as (
  select row_key, case when slot not in (0, 1) then order_date end as order_date,
         region, case when slot <> 6 then city end as city, category, sub_category,
         case when slot <> 3 then quantity end as quantity,
         case when slot <> 4 then unit_price end as unit_price,
         discount, case when slot <> 7 then sales end as sales, profit
  from slotted
)"""
