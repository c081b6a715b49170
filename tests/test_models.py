import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.operators import boosting as bo
from ledgerloom.operators import evaluation as ev
from ledgerloom.operators import features as ft
from ledgerloom.operators import forests as fo
from ledgerloom.operators import regressors as rg
from ledgerloom.plans import training as tr
from ledgerloom.session import materialise, scratch_path
from tests.conftest import SMALL

TINY = rg.Profile("tiny", trees=4, tree_depth=4, boost_rounds=4, adaboost_rounds=7, max_iter=500, fourier_features=32, landmarks=32)


@pytest.fixture(scope="module")
def cells(sales):
    return materialise(ft.demand_training_set(sales))


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) * [1, 2, 3, 1] + [0, 5, 0, 1]
    y = x @ [3.0, -2.0, 0.1, 0.0] + 4 + rng.normal(0, 0.5, 300)
    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])
    return x, y, df


def descent(x, y, flat, square):
    """Coordinate descent on 1/(2n) loss + flat |w| + square/2 w^2."""
    xc, yc = x - x.mean(axis=0), y - y.mean()
    n, w = len(y), np.zeros(x.shape[1])
    for _ in range(2000):
        for j in range(len(w)):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / n
            w[j] = np.sign(rho) * max(abs(rho) - flat, 0) / (xc[:, j] @ xc[:, j] / n + square)
    return w


@pytest.mark.parametrize(
    "name, flat, square", [("linear", 0, 0), ("ridge", 0, 1 / 300), ("lasso", 1.0, 0), ("elastic_net", 0.5, 0.5)]
)
def test_penalised_models_solve_the_library_problem(regression, name, flat, square):
    x, y, df = regression
    model = rg.CANDIDATES[name](df, ft.DEMAND, TINY).model.stages[0]
    np.testing.assert_allclose(model.coefficients.toArray(), descent(x, y, flat, square), atol=2e-4)


def test_linear_equals_least_squares_on_full_one_hot(cells):
    model = tr.fit_model(cells, ft.DEMAND, "linear")
    ready = tr._vectors(model.prepared, cells, ft.DEMAND)
    rows = model.core.predict(ready).select(vector_to_array("features").alias("x"), "label", "prediction").collect()
    x = np.column_stack([np.ones(len(rows)), np.array([r.x for r in rows])])
    best = x @ np.linalg.lstsq(x, np.array([r.label for r in rows]), rcond=None)[0]
    np.testing.assert_allclose([r.prediction for r in rows], best, atol=1e-3)


def test_unseen_category_is_all_zeros(spark):
    known = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, x double")
    asked = spark.createDataFrame([("a", 5.0), ("z", 6.0)], "c string, x double")
    got = ft.vectorised(ft.feature_pipeline(["c"], ["x"]).fit(known), asked)
    assert [list(r.v) for r in got.select(vector_to_array("features").alias("v")).collect()] == [[1, 0, 5], [0, 0, 6]]


def test_split_ignores_partitioning(cells):
    first = ft.with_split(cells.repartition(1)).select("row_key", "in_test")
    other = ft.with_split(cells.repartition(17)).select("row_key", "in_test")
    assert first.exceptAll(other).count() == 0
    share = first.agg(F.avg(F.col("in_test").cast("int"))).first()[0]
    assert 0.17 < share < 0.23


def test_time_holdout_is_the_latest(cells):
    train, test = ft.train_test_split(cells, holdout="time")
    month = F.col("order_year") * 12 + F.col("order_month")
    assert train.agg(F.max(month)).first()[0] < test.agg(F.min(month)).first()[0]


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 1.0), ("b", 5.0, 5.0), ("c", 5.0, 6.0)], "k string, label double, prediction double")
    got = {r.k: r for r in ev.error_metrics(df, ["k"]).collect()}
    assert (got["a"].mae, got["a"].rmse, got["a"].r2) == (1.5, pytest.approx(math.sqrt(2.5)), pytest.approx(-1.5))
    assert (got["b"].r2, got["c"].r2) == (1.0, 0.0)


def test_ties_keep_the_listing_order(spark):
    df = spark.createDataFrame([("t", "x", 1.0, 2.0, 2), ("t", "y", 1.0, 2.0, 1), ("t", "z", 1.0, 3.0, 0)], "task string, model string, mae double, rmse double, ordinal int")
    assert ev.comparison_pick(df).first().model == "y"


def _plain_adaboost(coder, rows, codes, raw, y, rounds, depth, seed):
    """The same rounds in a plain loop."""
    w, trees, votes = np.ones(len(y)), [], []
    for turn in range(rounds):
        draws = fo.resampled(seed, turn, rows, w * (len(y) / w.sum()))
        k = draws > 0
        piece = fo.grow(coder, codes[k], y[k], draws[k], depth, tree=turn, seed=seed, name=turn)
        error = np.abs(fo.walk(piece, raw, len(coder.cats)) - y)
        loss = (w * error).sum() / error.max() / w.sum()
        if loss >= 0.5:
            break
        trees.append(piece)
        votes.append(math.log((1 - loss) / loss))
        w = w * (loss / (1 - loss)) ** (1 - error / error.max())
    return trees, votes


@pytest.mark.parametrize("local", [fo.LOCAL_ROWS, 60])
def test_adaboost_rounds_equal_a_plain_loop(cells, monkeypatch, local):
    monkeypatch.setattr(fo, "LOCAL_ROWS", local)
    monkeypatch.setattr(fo, "BINS", 1_000)  # every value is a cut in the upper levels too
    small = materialise(cells.orderBy("row_key").limit(300))
    model = rg.fit_adaboost_r2(small, ft.DEMAND, TINY)
    names = [*ft.DEMAND.cats, *ft.DEMAND.nums]
    table = small.select("row_key", F.xxhash64("row_key").alias("h"), "label", *names).toPandas().sort_values("h")
    coder = model.coder
    raw = coder.raw([pa.array(table[c]) for c in names])
    trees, votes = _plain_adaboost(
        coder, table["h"].to_numpy(), coder.codes(raw), raw, table["label"].to_numpy(), TINY.adaboost_rounds, rg.BOOST_DEPTH, rg.SEED
    )
    assert len(votes) >= 2
    np.testing.assert_allclose(model.votes, votes, rtol=1e-9)
    got = {r.row_key: r.prediction for r in model.predict(small).collect()}
    for key, row in zip(table["row_key"], np.stack([fo.walk(t, raw, len(coder.cats)) for t in trees], axis=1)):
        order = np.argsort(row, kind="stable")
        running = np.cumsum(np.array(votes)[order])
        assert got[key] == pytest.approx(row[order][int(np.argmax(running >= 0.5 * running[-1]))])


@pytest.mark.parametrize("local", [fo.LOCAL_ROWS, 60])
def test_gradient_rounds_equal_a_plain_loop(cells, monkeypatch, local):
    monkeypatch.setattr(fo, "LOCAL_ROWS", local)
    monkeypatch.setattr(fo, "BINS", 1_000)
    monkeypatch.setattr(bo, "WRITTEN", 2)
    small = materialise(cells.orderBy("row_key").limit(300))
    profile = rg.Profile("seven", trees=1, tree_depth=1, boost_rounds=7, adaboost_rounds=1, max_iter=1)
    model = rg.fit_gbt(small, ft.DEMAND, profile)
    names = [*ft.DEMAND.cats, *ft.DEMAND.nums]
    table = small.select("row_key", "label", *names).toPandas()
    coder, y = model.coder, table["label"].to_numpy()
    raw = coder.raw([pa.array(table[c]) for c in names])
    told = np.full(len(y), y.mean())
    losses = [((y - told) ** 2).sum()]
    for turn in range(7):
        piece = fo.grow(coder, coder.codes(raw), y - told, np.ones(len(y)), rg.BOOST_DEPTH, tree=turn)
        told += rg.BOOST_RATE * fo.walk(piece, raw, len(coder.cats))
        losses.append(((y - told) ** 2).sum())
    got = {r.row_key: r.prediction for r in model.predict(small).collect()}
    reached = ((y - np.array([got[k] for k in table["row_key"]])) ** 2).sum()
    assert reached == pytest.approx(losses[-1], rel=1e-6) and all(a > b for a, b in zip(losses, losses[1:]))
    # Splits of equal worth may be chosen otherwise when sums are added in another order.
    assert np.mean([abs(got[k] - t) < 1e-6 for k, t in zip(table["row_key"], told)]) >= 0.98


def test_gradient_rows_stay_in_their_blocks(cells, monkeypatch):
    """A node's rows went to one task, which grew its subtree alone; now only sums per code leave a task."""

    def refused(*args):
        raise AssertionError("rows were dealt to nodes")

    monkeypatch.setattr(fo, "_dealt", refused)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 50)
    monkeypatch.setattr(bo, "TASK_ROWS", 100)
    small = materialise(cells.orderBy("row_key").limit(300))
    parted = bo.fit_gradient(small, ft.DEMAND.cats, ft.DEMAND.nums, 2, 3, 0.1)
    whole = bo.fit_gradient(small.coalesce(1), ft.DEMAND.cats, ft.DEMAND.nums, 2, 3, 0.1)
    told = {r.row_key: r.prediction for r in whole.predict(small).collect()}
    assert {r.row_key: pytest.approx(r.prediction) for r in parted.predict(small).collect()} == told
    assert all(t.top.splits and len(t.top.values) == len(t.top.splits) + 1 for t in parted.trees)


def test_gradient_without_labels_or_differences(spark):
    empty = spark.createDataFrame([], "row_key string, c string, x double, label double")
    rows = spark.createDataFrame([("a", None, 1.0, 3.0), ("b", "u", None, 3.0), ("c", "u", 2.0, None)], "row_key string, c string, x double, label double")
    assert [r.prediction for r in bo.fit_gradient(empty, ("c",), ("x",), 2, 3, 0.1).predict(rows).collect()] == [0.0] * 3
    assert [r.prediction for r in bo.fit_gradient(rows, ("c",), ("x",), 2, 3, 0.1).predict(rows).collect()] == [3.0] * 3


def test_draws_follow_their_expected_counts():
    rows = np.arange(50_000)
    for expected in (0.0, 0.3, 4.0, 31.0, 900.0):
        drawn = fo.resampled(1, 2, rows, np.full(len(rows), expected))
        assert abs(drawn.mean() - expected) <= 0.03 * expected and abs(drawn.var() - expected) <= 0.05 * expected


def test_compare_refit_save_load(spark, cells):
    train, test = ft.train_test_split(cells)
    models, results = tr.fit_candidates(train, test, ft.DEMAND, profile=TINY)
    table = tr.model_comparison(results).collect()
    assert {r.model for r in table} == set(rg.CANDIDATES) and [r.place for r in table] == list(range(1, 11))
    assert all(a.mae <= b.mae for a, b in zip(table, table[1:])) and {r.profile for r in table} == {"tiny"}
    for name in ("gbt", "random_cut_forest", "adaboost_r2", "knn", "rbf_svr"):
        path = scratch_path(spark, name)
        models[name].save(path)
        before = models[name].predict(test).select("row_key", "prediction")
        after = tr.TaskModel.load(spark, path).predict(test).select("row_key", "prediction")
        differs = before.join(after.withColumnRenamed("prediction", "p"), "row_key").where(F.abs(F.col("prediction") - F.col("p")) > 1e-9)
        assert before.count() == test.count() and differs.count() == 0


def test_refit_uses_all_rows(cells):
    model, table = tr.refit_best(cells, ft.DEMAND, ("linear", "lasso"), TINY, holdout="time")
    assert model.name == table.orderBy("place").first().model and table.count() == 2


def test_registered_queries_fit_at_full_size(spark, monkeypatch):
    from ledgerloom.plans.catalog import models

    sizes = []

    class Seen(Exception):
        pass

    def stop(*args, profile=None, **_):
        sizes.append((profile or next((a for a in args if isinstance(a, rg.Profile)), None)))
        raise Seen

    for name in ("fit_model", "fit_candidates", "refit_best"):
        monkeypatch.setattr(models.tr, name, stop)
    queries = ("model_random_forest", "model_random_cut_forest", "fit_candidates", "model_comparison", "refit_best")
    for name in queries:
        with pytest.raises(Seen):
            models.QUERIES[name](spark, SMALL)
    assert sizes == [None] * len(queries)  # the default, rg.FULL
    assert {(p.trees, p.tree_depth) for p in rg.FULL.values()} == {(400, None), (300, None)}


def test_a_task_reads_a_bounded_part_of_the_training_vectors(spark, monkeypatch):
    monkeypatch.setattr(tr, "ROWS_PER_TASK", 100)
    rows = spark.range(0, 450, 1, 1).select(
        F.col("id").cast("string").alias("row_key"), *[F.lit("a").alias(c) for c in ft.DEMAND.cats],
        *[(F.col("id") % 7).cast("double").alias(c) for c in ft.DEMAND.nums], F.col("id").cast("double").alias("label"),
    )
    kept = tr._kept(ft.feature_pipeline(ft.DEMAND.cats, ft.DEMAND.nums).fit(rows), rows, ft.DEMAND)
    parts = [r[0] for r in kept.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(parts) == 450 and len(parts) == 5 and max(parts) <= 100
    assert "onehot" not in kept.columns
    kept.unpersist()


def test_boosting_rounds_leave_no_tables_behind(spark, monkeypatch):
    paths = []
    fresh = session.scratch_path

    def watched(*given):
        paths.append(fresh(*given))
        return paths[-1]

    monkeypatch.setattr(session, "scratch_path", watched)
    rows = spark.range(0, 200, 1, 2).select(
        F.col("id").cast("string").alias("row_key"), F.lit("a").alias("c"), (F.col("id") % 17).cast("double").alias("x"),
        ((F.col("id") % 17) * 3 + F.col("id") % 5).cast("double").alias("label"),
    )
    model = bo.fit_adaboost(rows, ["c"], ["x"], 4, 2)
    assert len(model.trees) >= 2
    written = sum(os.path.getsize(os.path.join(p, f)) for p in paths if os.path.isdir(p) for f in os.listdir(p) if f.endswith(".parquet"))
    assert len(paths) > 2 and written == 0
    assert model.predict(rows).where(F.col("prediction").isNull()).count() == 0


@pytest.mark.parametrize("fit", ["gbt", "adaboost_r2"])
def test_numbers_of_many_values_are_cut_at_every_value(cells, monkeypatch, fit):
    """Beyond ``CODES`` values only their quantiles were told apart."""
    small = materialise(cells.orderBy("row_key").limit(300))
    whole = rg.CANDIDATES[fit](small, ft.DEMAND, TINY)
    monkeypatch.setattr(fo, "CODES", 26)
    monkeypatch.setattr(fo, "QUANTILES", 9)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 50)
    binned = rg.CANDIDATES[fit](small, ft.DEMAND, TINY)
    assert binned.coder.wide == (5,) and whole.coder.wide == ()
    want = {r.row_key: r.prediction for r in whole.predict(small).collect()}
    got = {r.row_key: r.prediction for r in binned.predict(small).collect()}
    assert np.mean([abs(got[k] - want[k]) < 1e-6 for k in want]) >= 0.98
    seen = {r[0] for r in small.select("avg_unit_price").collect()}
    edges = set(binned.coder.values[0].tolist()) | {0.0}
    cuts = [s[1] for t in binned.trees for s in t.top.splits.values() if s[0] == 5]
    assert cuts and len(edges) <= 11 < len(seen)


def test_bins_that_may_hold_the_best_cut_hold_it():
    r = np.random.default_rng(5)
    for turn in range(200):
        x, w = np.sort(r.integers(0, 60, 80)).astype(float), r.integers(1, 4, 80).astype(float)
        y = r.normal(0, 1, 80) * (r.random(80) < 0.3) + (x > r.integers(60)) * r.integers(3) + r.normal()
        edges = np.unique(r.integers(0, 60, 6)).astype(float)
        code = np.minimum(np.searchsorted(edges, x), len(edges) - 1)
        n, s, up = (np.bincount(code, v, len(edges)) for v in (w, w * y, w * np.maximum(y, 0)))
        mean, bins = s.sum() / n.sum(), np.flatnonzero(n)
        n, s, up = n[bins], (s - n * mean)[bins], up[bins]
        floor, bounds, before_n, before_s = fo.bin_bounds(n, s, up, mean, np.abs(y - mean).max())
        values, wv, sv = fo.per_value(x, w, w * (y - mean))
        wl, sl = np.cumsum(wv)[:-1], np.cumsum(sv)[:-1]
        gains = sl * sl / wl + sl * sl / (w.sum() - wl)
        at = np.searchsorted(bins, np.minimum(np.searchsorted(edges, values), len(edges) - 1))
        assert floor <= gains.max() + 1e-9 and all(gains[i] <= bounds[at[i]] for i in range(len(gains)))
        keep = np.flatnonzero(bounds >= floor * (1 - 2 * fo.TIE))
        near = np.isin(at, np.append(keep, keep + 1))
        found = fo.best_value(values[near], bins[at][near], wv[near], sv[near], bins[keep], before_n[keep], before_s[keep], w.sum())
        k = int(np.argmax(gains >= gains.max() * (1 - fo.TIE)))
        assert found[:2] == pytest.approx((gains.max(), (values[k] + values[k + 1]) / 2))
        assert found[2:] == pytest.approx((wl[k], sl[k] / wl[k], -sl[k] / (w.sum() - wl[k])))


def test_adaboost_rows_stay_in_their_blocks(cells, monkeypatch):
    """All rows of a node went to one task in each round; now only sums per code leave a task."""

    def refused(*args):
        raise AssertionError("rows were dealt to nodes")

    monkeypatch.setattr(fo, "_dealt", refused)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 50)
    monkeypatch.setattr(bo, "TASK_ROWS", 100)
    small = materialise(cells.orderBy("row_key").limit(300))
    assert len(bo.fit_adaboost(small, ft.DEMAND.cats, ft.DEMAND.nums, 3, 3).trees) == 3
