"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import materialise, tune

# A table is broadcast only after its bytes were added up and found below this.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``df`` written once, and whether its text form stays within ``max_bytes``."""
    kept = materialise(df)
    size = kept.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return kept, size <= max_bytes


def hinted(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written once and marked for broadcast if its size allows it."""
    kept, fits = small(df, max_bytes)
    return F.broadcast(kept) if fits else kept


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; a column that is absent comes as null."""
    have = {c.lower() for c in df.columns}
    return df.select(*(
        (F.col(f"`{name}`") if name.lower() in have else F.lit(None)).cast(kind).alias(name)
        for name, kind in kinds.items()
    ))


def boxed(df: DataFrame, **beside: Column) -> DataFrame:
    """``row``, a struct of all columns, and the given ones beside it.

    What an operator adds cannot clash with a column of its input; ``row.*``
    gives the input's columns and values back.
    """
    return df.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in beside.items()])


def column(df: DataFrame, name: str, kind: str) -> Column:
    """A column cast, or null where it is absent."""
    have = {c.lower() for c in df.columns}
    return (df[f"`{name}`"] if name.lower() in have else F.lit(None)).cast(kind)


def text_key(text: Column) -> Column:
    """64 bits that stand for a text beside its id; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def copy_schema(df: DataFrame) -> T.StructType:
    return T.StructType(list(df.schema.fields))
