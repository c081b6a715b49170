"""The pipeline's stages against what each operator says about the stage's own input."""

from collections import Counter

import corpus_pipeline
from ledgerloom.llm import bpe, decontaminate, jaccard, outliers, secrets
from ledgerloom.session import materialise, scratch_path
from tests.conftest import SMALL
from tests.llm import cases


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "jaccard_join", "decontamination", "secret_scan", "bpe_round_trip"]
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SMALL)))
        if name != names[-1]:
            assert out[-1].columns == docs.columns
    ids = [{r.doc_id for r in o.select("doc_id").collect()} for o in out]
    assert ids[1] == {r.doc_id for r in outliers.quality(out[0]).filter("kept").collect()}
    assert ids[2] == {r.doc_id for r in jaccard.classes(out[1]).filter("is_kept").collect()}
    assert ids[3] == {r.doc_id for r in decontaminate.contamination(out[2], bench).filter("not contaminated").collect()}
    assert ids[4] == ids[3] == ids[5]
    base = secrets.digests(secrets.secrets(out[4])).selectExpr("sum(n_assign + n_access + n_hex) as n").first().n
    assert base == 0
    want = {tuple(r) for r in bpe.token_rows(out[4]).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()} == want and want


def _written(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_keep_every_column_of_awkward_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, names that the operators use inside."""
    names = ("row", "id", "key", "worded", "many", "kept_id", "_kept", "_counts", "_failed", "_distance", "_0", "_k_many", "_k_id", "TEXT_key")
    data = [(*d, *[f"{n}{i}" for n in names]) for i, d in enumerate(cases.rows())]
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = materialise(spark.createDataFrame(data, schema))
    folder = _written(spark, scratch_path(spark, "awkward"), docs)
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = {tuple(r) for r in out.collect()}, materialise(stage(spark, out, folder))
        assert out.columns == docs.columns and out.count()
        rows = {tuple(r) for r in out.collect()}
        # Redaction changes texts alone; the other stages only drop rows.
        assert ({r[:1] + r[2:] for r in rows} <= {r[:1] + r[2:] for r in before}) if name == "secret_scan" else rows <= before
    last = corpus_pipeline.STAGES[-1][1](spark, out, folder)
    assert last.count() == out.count()
    assert Counter(bpe.vocabulary(bpe.default_vocabulary()).decode(r.ids) for r in last.collect()) == Counter(r.text or "" for r in out.collect())


def test_stages_of_an_empty_table(spark):
    folder = _written(spark, scratch_path(spark, "none"), cases.empty(spark))
    assert corpus_pipeline.run(spark, folder).count() == 0
