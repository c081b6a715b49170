import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.features import DEMAND, SALES, training_set
from ledgerloom.operators.lookup import serving_tables
from ledgerloom.plans import scoring
from ledgerloom.plans.catalog import scoring as catalog_scoring
from ledgerloom.plans.catalog.scoring import demand_requests, sales_requests
from ledgerloom.plans.registry import ModelRegistry, train_and_publish
from ledgerloom.plans.training import fit_model
from ledgerloom.session import materialise, scratch_path
from ledgerloom.sources.requests import parse_requests, split_requests, to_response
from ledgerloom.streaming.scoring import json_request_stream, request_stream, score_request_stream, write_dead_letters
from tests.conftest import SMALL


def run(spark, requests, task, model, tables):
    base = scratch_path(spark, "stream-test")
    requests.repartition(3).write.parquet(f"{base}/in")

    def once():
        query = score_request_stream(
            request_stream(spark, f"{base}/in", 1), task, model, tables, f"{base}/out", f"{base}/progress"
        )
        query.awaitTermination()
        return spark.read.parquet(f"{base}/out/batch=*")

    first = once().count()
    assert once().count() == first  # nothing new, nothing twice
    return once()


def test_demand_stream_equals_batch(spark, sales):
    tables = serving_tables(sales)
    model = fit_model(training_set(sales, DEMAND), DEMAND, "ridge")
    requests = demand_requests(sales)
    answered = run(spark, requests, "demand", model, tables)
    valid, rejected = split_requests(parse_requests(requests, "demand"))
    batch = to_response(scoring.predict_demand(valid.drop("payload"), tables, model), "demand").select("request_id", "response")
    assert answered.where("model_version is not null").count() == 0
    good = answered.where("error is null").select("request_id", "response")
    assert answered.count() == sales.count() and answered.where("error is not null").count() == rejected.count()
    assert good.exceptAll(batch).count() == 0 and good.count() == batch.count()
    assert good.where(F.get_json_object("response", "$.predicted_total_quantity").cast("int") < 0).count() == 0


def test_sales_stream(spark, sales):
    model = fit_model(training_set(sales, SALES), SALES, "ridge")
    answered = run(spark, sales_requests(sales), "sales", model, serving_tables(sales))
    assert answered.count() == sales.count()
    good = answered.where("error is null")
    assert good.where(F.get_json_object("response", "$.predicted_sales").isNull()).count() == 0


@pytest.fixture(scope="module")
def registry(spark, sales):
    """Serves a ridge model for both tasks, chosen among two."""
    made = ModelRegistry(spark, scratch_path(spark, "registry-test"))
    fitted = {t.name: train_and_publish(materialise(training_set(sales, t)), t, made, ("ridge", "linear"))[1] for t in (DEMAND, SALES)}
    return made, fitted


@pytest.fixture
def served(registry, monkeypatch):
    from ledgerloom.plans.catalog import scoring as catalog

    monkeypatch.setattr(catalog, "published", lambda spark, folder, task: (registry[0], registry[1][task.name]))
    return catalog


def flags(df, *names):
    return {tuple(r) for r in df.select(*names).distinct().collect()}


def test_served_answers_are_the_winners(spark, served):
    assert flags(served.predict_demand(spark, SMALL), "counted", "current", "skilled") == {(True, True, True)}
    assert flags(served.predict_sales(spark, SMALL), "rounded", "current", "skilled") == {(True, True, True)}


def test_a_wrong_model_fails_the_served_answers(spark, served, monkeypatch):
    right = scoring.predict_demand

    def constant(*args, **options):
        return right(*args, **options).withColumn("predicted_total_quantity", F.lit(7).cast("bigint"))

    monkeypatch.setattr(served.plan, "predict_demand", constant)
    got = flags(served.predict_demand(spark, SMALL), "counted", "skilled")
    assert (False, False) in got and (True, True) not in got


def test_a_stale_model_fails_the_served_answers(spark, sales, served, registry, monkeypatch):
    old = registry[0].load("demand")
    newer = fit_model(training_set(sales, DEMAND), DEMAND, "ridge")
    version = old.version
    registry[0].publish(newer, registry[0].comparison("demand"))
    monkeypatch.setattr(registry[0], "load", lambda task: old)
    assert flags(served.predict_demand(spark, SMALL), "current") == {(False,)}
    registry[0].rollback("demand", version)


def lines(spark, folder, rows, name):
    made = [json.dumps({"request_id": i, "sent_at": t, "payload": p}) if i != "broken" else p for i, t, p in rows]
    spark.createDataFrame([(m,) for m in made], "value string").coalesce(1).write.text(f"{folder}/{name}.parts")
    part = next(f for f in os.listdir(f"{folder}/{name}.parts") if f.endswith(".txt"))
    os.makedirs(f"{folder}/in", exist_ok=True)
    shutil.copy(f"{folder}/{name}.parts/{part}", f"{folder}/in/{name}.txt")


def test_json_files_with_repeats_late_and_broken_lines(spark, sales, registry):
    base = scratch_path(spark, "json-test")
    os.makedirs(base)
    tables = serving_tables(sales)
    good = sales.select("category", "sub_category", "region").first().asDict() | {"year": 1995, "month": 3}

    def run():
        requests, dead = json_request_stream(spark, f"{base}/in", 1, late="1 hour")
        for query in (
            score_request_stream(requests, "demand", registry[0], tables, f"{base}/out", f"{base}/progress"),
            write_dead_letters(dead, f"{base}/dead", f"{base}/dead-progress"),
        ):
            query.awaitTermination()
        answers = spark.read.schema("request_id string, response string, error string, model_version string").parquet(f"{base}/out/batch=*")
        return {r.request_id: r for r in answers.collect()}, answers.count(), [r.value for r in spark.read.parquet(f"{base}/dead").collect()]

    lines(spark, base, [
        ("a", "2025-01-01T00:00:00Z", good), ("a", "2025-01-01T00:05:00Z", good), ("b", "2025-01-01T00:00:00Z", {"month": "x"}),
        ("c", "2025-01-01T00:00:00Z", json.dumps(good)), ("broken", None, "{not json"), ("broken", None, ""), ("broken", None, "[1]"),
        ("d", "no time", good), (None, "2025-01-01T00:00:00Z", good), ("e", "2025-01-01T00:00:00Z", "no json"),
    ], "one")
    answers, n, dead = run()
    assert set(answers) == {"a", "b", "c", "e"} and n == 4 and len(dead) == 5
    assert answers["a"].response == answers["c"].response and answers["a"].error is None
    assert answers["b"].error == answers["e"].error != None  # noqa: E711
    assert answers["a"].model_version == registry[0].current("demand") and answers["b"].model_version is None
    # A restart goes on behind the files it has answered, and remembers their ids.
    lines(spark, base, [("a", "2025-01-01T00:10:00Z", good), ("f", "2025-01-02T00:00:00Z", good)], "two")
    answers, n, dead = run()
    assert set(answers) == {"a", "b", "c", "e", "f"} and n == 5 and len(dead) == 5
    # Far behind the newest time a request is no longer taken.
    lines(spark, base, [("g", "2025-01-01T00:00:00Z", good), ("h", "2025-01-02T00:30:00Z", good)], "three")
    answers, n, _ = run()
    assert "g" not in answers and "h" in answers and n == 6


def test_request_files_hold_bounded_numbers_of_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog_scoring, "LINES_PER_FILE", 10)
    monkeypatch.setattr(catalog_scoring, "MAX_FILES", 7)
    lines = spark.range(95).select(F.col("id").cast("string").alias("value"))
    assert catalog_scoring._sent(lines, f"{tmp_path}/many") == 5
    files = spark.read.text(f"{tmp_path}/many").groupBy(F.input_file_name()).agg(F.count("value"), F.collect_list("value")).collect()
    assert len(files) == 10 and max(r[1] for r in files) <= 20
    assert sorted(int(v) for r in files for v in r[2]) == list(range(95))
    assert catalog_scoring._sent(lines.limit(9), f"{tmp_path}/few") == 2
    assert catalog_scoring._sent(lines.unionAll(lines), f"{tmp_path}/more") == 7
