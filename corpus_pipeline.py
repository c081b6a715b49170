"""A corpus pipeline: each stage's rows are written as Parquet and read by the next.

Quality rules reject documents, near copies leave one of each class,
contaminated documents go, secrets are redacted, and the rest is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, decontaminate, jaccard, outliers, secrets
from ledgerloom.llm.common import table
from ledgerloom.session import materialise, tune


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and lie near their language's and source's centre; null and
    empty texts fail."""
    tune(spark)
    return outliers.drop_rejected(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies; texts without words all stay, also where they repeat."""
    tune(spark)
    return jaccard.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark passage of the contract's size; an empty benchmark keeps all."""
    tune(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; null texts stay null."""
    tune(spark)
    return secrets.redact(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of each document; null and empty texts have no ids."""
    tune(spark)
    return bpe.token_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_round_trip", bpe_round_trip),
]

# The robust estimates and the automata have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
