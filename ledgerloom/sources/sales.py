"""Sales table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.scalars import DATE_FORMATS, blank_to_null, iso_date_text, parse_date, parse_number

# File header of a sales CSV and the field name used in every operator.
CSV_NAMES = {
    "Order ID": "order_id",
    "Order Date": "order_date",
    "Customer Name": "customer_name",
    "Region": "region",
    "City": "city",
    "Category": "category",
    "Sub-Category": "sub_category",
    "Product Name": "product_name",
    "Quantity": "quantity",
    "Unit Price": "unit_price",
    "Discount": "discount",
    "Sales": "sales",
    "Profit": "profit",
    "Payment Mode": "payment_mode",
}

FIELD_TYPES = {
    "order_id": "bigint",
    "order_date": "date",
    "customer_name": "string",
    "region": "string",
    "city": "string",
    "category": "string",
    "sub_category": "string",
    "product_name": "string",
    "quantity": "decimal(18,4)",
    "unit_price": "decimal(18,4)",
    "discount": "decimal(18,4)",
    "sales": "decimal(18,4)",
    "profit": "decimal(18,4)",
    "payment_mode": "string",
}

REQUIRED_COLUMNS = tuple(name for name in CSV_NAMES.values() if name != "order_id")


def typed_sales(raw: DataFrame, date_formats=DATE_FORMATS) -> DataFrame:
    """Type the text columns of a raw sales frame; bad values become NULL."""
    columns = []
    for name in raw.columns:
        kind = FIELD_TYPES.get(name, "string")
        text = blank_to_null(name)
        if kind == "date":
            columns.append(parse_date(text, date_formats).alias(name))
        elif kind == "bigint":
            # 3.0 is a whole number in a CSV column that holds gaps.
            columns.append(parse_number(text, "decimal(38,6)").try_cast("bigint").alias(name))
        elif kind.startswith("decimal"):
            columns.append(parse_number(text, kind).alias(name))
        else:
            columns.append(text.alias(name))
    return raw.select(*columns)


# Quotes are doubled inside quoted values.
CSV_DIALECT = {"header": True, "quote": '"', "escape": '"'}


def raw_sales(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """A sales CSV with field names, all columns as text.

    The header is read on its own, so optional columns may be absent and the
    data scan needs no inference pass. Files of one folder must share their
    column order; another order raises instead of shifting values. Quoted line
    breaks need ``multi_line``, for which a file is one task: switch it off for
    few large files without them.
    """
    header = spark.read.options(**CSV_DIALECT).csv(path).columns
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    reader = spark.read.schema(schema).options(**CSV_DIALECT, mode="PERMISSIVE", enforceSchema=False, multiLine=multi_line)
    return reader.csv(path).toDF(*[CSV_NAMES.get(name, name) for name in header])


def read_sales(spark: SparkSession, path: str, *, date_formats=DATE_FORMATS, multi_line: bool = True) -> DataFrame:
    """Scan a sales CSV and type its columns; ``conversion_losses`` counts what did not fit."""
    return typed_sales(raw_sales(spark, path, multi_line=multi_line), date_formats)


def conversion_losses(raw: DataFrame, date_formats=DATE_FORMATS) -> DataFrame:
    """One row per typed column: filled texts, and those that became NULL."""
    names = [n for n in raw.columns if FIELD_TYPES.get(n, "string") != "string"]
    typed = typed_sales(raw.select(*names, *[F.col(n).alias(f"{n}_text") for n in names]), date_formats)
    counts = typed.agg(*[
        F.struct(F.count(f"{n}_text").alias("filled"), F.count(F.when(F.col(n).isNull(), F.col(f"{n}_text"))).alias("lost")).alias(n)
        for n in names
    ])
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), f"{n}.filled", f"{n}.lost") for n in names])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """A repeatable key for rows of any source: a digest of all columns and a copy number.

    Only rows alike in every column share a digest, so groups stay small.
    """
    text = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    digested = df.withColumn(name, F.md5(text))
    copy = F.row_number().over(W.partitionBy(name).orderBy(name))
    return digested.withColumn(name, F.concat_ws("-", name, copy))


def column_report(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """One row per required column, absent ones included, with its filled rows."""
    present = [name for name in required if name in df.columns]
    missing = [name for name in required if name not in df.columns]
    counts = df.agg(*[F.count(name).alias(name) for name in present], F.count(F.lit(1)).alias("_rows"))
    entries = [
        F.struct(F.lit(n).alias("column_name"), F.lit(False).alias("missing"), F.col(n).alias("filled_rows"))
        for n in present
    ] + [
        F.struct(F.lit(n).alias("column_name"), F.lit(True).alias("missing"), F.lit(0).cast("bigint").alias("filled_rows"))
        for n in missing
    ]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def with_optional_columns(df: DataFrame, names=tuple(CSV_NAMES.values())) -> DataFrame:
    """Add absent columns as typed NULL so later steps can name them."""
    absent = {n: F.lit(None).cast(FIELD_TYPES[n]) for n in names if n not in df.columns}
    return df.withColumns(absent) if absent else df


def write_sales(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a sales table; CSV gets file header names and dates as text."""
    if fmt != "csv":
        df.write.mode("overwrite").format(fmt).save(path)
        return
    columns = []
    for header, name in CSV_NAMES.items():
        if name in df.columns:
            value = iso_date_text(name) if name == "order_date" else F.col(name)
            columns.append(value.alias(header))
    df.select(*columns).write.mode("overwrite").options(**CSV_DIALECT).csv(path)


# Compressed file bytes up to which a joined dimension is broadcast.
BROADCAST_BYTES = 8 << 20

# Declared, so that opening a table needs no inference job.
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rebalance a scan that has fewer splits than the cluster has cores.

    A file with a single row group is one task whatever its size; large tables
    have more splits than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def stored_bytes(scan: DataFrame) -> int:
    """File bytes behind a plain table scan, as the planner knows them."""
    return int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def star_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Flat sales rows from the star schema.

    Orders meet customers before order lines do, so the wide line table is
    shuffled once per large join key. The planner overrates joined dimensions
    and would rather send the order lines around, so dimensions whose files
    were found small are marked; larger ones are joined by shuffle.
    """
    table = {
        name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, schema in STAR_SCHEMAS.items()
    }
    size = {name: stored_bytes(scan) for name, scan in table.items()}

    def dimension(df: DataFrame, *names: str) -> DataFrame:
        return F.broadcast(df) if sum(size[n] for n in names) <= BROADCAST_BYTES else df

    places = table["nation"].join(dimension(table["region"], "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = table["customer"].join(
        dimension(places, "nation", "region"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    headers = table["orders"].join(
        dimension(buyers, "customer", "nation", "region"), F.col("o_custkey") == F.col("c_custkey")
    )
    lines = (
        spread(table["lineitem"], "l_orderkey", "l_partkey")
        .join(
            dimension(headers, "orders", "customer", "nation", "region"), F.col("l_orderkey") == F.col("o_orderkey")
        )
        .join(dimension(table["part"], "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    price_cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + F.lit(0.5)).cast("bigint")
    sales = F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    cost = F.col("l_quantity").cast("decimal(5,0)") * F.col("p_retailprice").cast("decimal(12,2)")
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.concat_ws(
            "-",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            *[F.col(c).cast("decimal(12,2)").cast("string") for c in ("l_quantity", "l_extendedprice")],
        ).alias("row_key"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("c_name").alias("customer_name"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("city"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        F.col("p_name").alias("product_name"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (price_cents.cast("decimal(14,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)").alias("unit_price"),
        (F.col("l_discount") * 100).cast("decimal(5,2)").alias("discount"),
        sales.cast("decimal(18,4)").alias("sales"),
        (sales - cost).cast("decimal(18,4)").alias("profit"),
        F.col("o_orderpriority").alias("payment_mode"),
    )
