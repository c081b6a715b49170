"""The registered query of each operator, over its whole table, and its oracle text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    align, bpe, chat, decontaminate, divergence, jaccard, licenses, oracles, outliers, repair, secrets, sites, suffixes, tagpaths,
)
from ledgerloom.llm.common import table, typed
from ledgerloom.session import materialise, scratch_path


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secrets(table(spark, sf_dir, "documents")))


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality(table(spark, sf_dir, "documents"))


def op4_site_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    repair.write_ids(table(spark, sf_dir, "documents"), path)
    return repair.read_digests(spark, path)


CONTROL = """select * from values
    (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"""


def op6_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}
    turns = typed(table(spark, sf_dir, "conversations"), **kinds).union(typed(spark.sql(CONTROL), **kinds))
    return chat.digests(materialise(chat.render(chat.messages(chat.event_log(turns)))))


def op7_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.articles(table(spark, sf_dir, "pages"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "is_kept", "n_copies", "n_links")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_robust_outliers": op3_robust_outliers,
    "op4_site_posteriors": op4_site_posteriors,
    "op5_repair_ids": op5_repair_ids,
    "op6_chat_events": op6_chat_events,
    "op7_tag_paths": op7_tag_paths,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontamination": op10_decontamination,
    "op11_license_scan": op11_license_scan,
    "op12_source_divergence": op12_source_divergence,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES = {
    "op6_chat_events": oracles.CHAT_SQL,
    "op9_jaccard_join": oracles.JACCARD_SQL,
    "op10_decontamination": oracles.DECONTAMINATION_SQL,
    "op11_license_scan": oracles.LICENSES_SQL,
    "op12_source_divergence": oracles.DIVERGENCE_SQL,
}
