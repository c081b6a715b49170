"""Forests: each split against brute force, upper levels, draws, saving."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import features as ft
from ledgerloom.operators import forests as fo
from ledgerloom.operators import regressors as rg
from ledgerloom.plans import training as tr
from ledgerloom.session import materialise, scratch_path

CATS, NUMS = ("c", "d"), ("x", "y")


def made(n: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    cats = np.stack([rng.integers(0, 5, n), rng.integers(0, 3, n)], axis=1)
    nums = np.stack([rng.integers(0, 40, n) / 4.0, rng.normal(0, 1, n).round(1)], axis=1)
    label = (np.array([5.0, -3.0, 0.0, 9.0, 2.0])[cats[:, 0]] * nums[:, 0] + 4 * (nums[:, 1] > 0.3) + rng.normal(0, 1, n)).round(3)
    coder = fo.Coder(CATS, NUMS, tuple(tuple(map(str, range(k))) for k in (5, 3)), tuple(np.unique(nums[:, i]) for i in range(2)))
    raw = np.concatenate([cats.astype(float), nums], axis=1)
    return coder, raw, label


def frame(spark, raw, label):
    rows = [(f"k{i}", str(int(r[0])), str(int(r[1])), float(r[2]), float(r[3]), float(y)) for i, (r, y) in enumerate(zip(raw, label))]
    return materialise(spark.createDataFrame(rows, "row_key string, c string, d string, x double, y double, label double"))


def loss(y, w):
    return float((w * (y - np.average(y, weights=w)) ** 2).sum()) if len(y) else 0.0


def every_split(coder, raw, y, w):
    """The least loss any split of these rows leaves; categories by all subsets."""
    best = np.inf
    for f in range(raw.shape[1]):
        values = np.unique(raw[:, f])
        if f < len(coder.cats):
            sides = [np.isin(raw[:, f], values[[bool(m >> i & 1) for i in range(len(values))]]) for m in range(1, 2 ** len(values) - 1)]
        else:
            sides = [raw[:, f] <= v for v in values[:-1]]
        best = min([best, *[loss(y[s], w[s]) + loss(y[~s], w[~s]) for s in sides]])
    return best


def parts(piece, node, raw, n_cats):
    f = piece.feature[node]
    if f < n_cats:
        return np.isin(node << 16 | raw[:, f].astype(np.int64), piece.sets)
    return raw[:, f] <= piece.number[node]


def test_every_split_is_the_best_of_all():
    coder, raw, y = made(160)
    w = fo.row_weights(7, 3, np.arange(160)).astype(float)
    raw, y, w = raw[w > 0], y[w > 0], w[w > 0]
    piece = fo.grow(coder, coder.codes(raw), y, w, fo.UNLIMITED)
    todo, seen = [(0, np.arange(len(y)))], 0
    while todo:
        node, rows = todo.pop()
        if piece.feature[node] == fo.LEAF:
            assert piece.number[node] == pytest.approx(np.average(y[rows], weights=w[rows]))
            assert len(set(y[rows])) == 1 or len(np.unique(raw[rows], axis=0)) == 1
            continue
        left = parts(piece, node, raw[rows], 2)
        assert left.any() and not left.all()
        left_loss = loss(y[rows[left]], w[rows[left]]) + loss(y[rows[~left]], w[rows[~left]])
        assert left_loss == pytest.approx(every_split(coder, raw[rows], y[rows], w[rows]), abs=1e-8)
        todo += [(piece.left[node], rows[left]), (piece.left[node] + 1, rows[~left])]
        seen += 1
    assert seen > 50


def test_random_cuts_lie_between_the_least_and_greatest_value():
    coder, raw, y = made(300)
    piece = fo.grow(coder, coder.codes(raw), y, np.ones(300), fo.UNLIMITED, random_cuts=True, tree=4, seed=9)
    other = fo.grow(coder, coder.codes(raw), y, np.ones(300), fo.UNLIMITED, random_cuts=True, tree=5, seed=9)
    assert not np.array_equal(piece.number, other.number)
    todo, singles = [(0, np.arange(300))], 0
    while todo:
        node, rows = todo.pop()
        f = piece.feature[node]
        if f == fo.LEAF:
            continue
        left = parts(piece, node, raw[rows], 2)
        assert left.any() and not left.all()
        if f < 2:
            assert min(len(set(raw[rows[left], f])), len(set(raw[rows[~left], f]))) == 1
            singles += 1
        else:
            assert raw[rows, f].min() <= piece.number[node] < raw[rows, f].max()
        todo += [(piece.left[node], rows[left]), (piece.left[node] + 1, rows[~left])]
    assert singles
    # All rows are in every tree: grown to the end, a tree gives the mean label of equal rows.
    _, group = np.unique(raw, axis=0, return_inverse=True)
    means = np.bincount(group.ravel(), y) / np.bincount(group.ravel())
    np.testing.assert_allclose(fo.walk(piece, raw, 2), means[group.ravel()], atol=1e-9)


def test_row_weights_are_poisson_draws():
    w = fo.row_weights(42, 1, np.arange(100_000))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert (w == fo.row_weights(42, 1, np.arange(100_000))).all() and (w != fo.row_weights(42, 2, np.arange(100_000))).any()


@pytest.mark.parametrize("random_cuts", [False, True])
def test_a_forest_on_spark_equals_its_trees(spark, random_cuts):
    coder, raw, y = made(400)
    df = frame(spark, raw, y)
    model = fo.fit_forest(df.repartition(3), CATS, NUMS, 5, seed=11, random_cuts=random_cuts)
    got = {r.row_key: r.prediction for r in model.predict(df).collect()}
    hashes = {r.row_key: r.h for r in df.select("row_key", F.xxhash64("row_key").alias("h")).collect()}
    rows = np.array([hashes[f"k{i}"] for i in range(400)])
    order = np.argsort(rows)
    want = np.zeros(400)
    for t in range(5):
        w = np.ones(400) if random_cuts else fo.row_weights(11, t, rows)
        o = order[w[order] > 0]
        piece = fo.grow(coder, coder.codes(raw[o]), y[o], w[o], fo.UNLIMITED, tree=t, seed=11, name=t, random_cuts=random_cuts)
        want += fo.walk(piece, raw, 2)
    np.testing.assert_allclose([got[f"k{i}"] for i in range(400)], want / 5, atol=1e-9)


@pytest.mark.parametrize("random_cuts", [False, True])
def test_upper_levels_split_like_the_lower_ones(spark, monkeypatch, random_cuts):
    _, raw, y = made(400)
    df = frame(spark, raw, y)
    whole = fo.fit_forest(df, CATS, NUMS, 3, seed=5, random_cuts=random_cuts)
    monkeypatch.setattr(fo, "LOCAL_ROWS", 40)
    monkeypatch.setattr(fo, "SUMS_BYTES", 10_000)
    monkeypatch.setattr(fo, "BLOCK_BYTES", 3_000)
    cut = fo.fit_forest(df, CATS, NUMS, 3, seed=5, random_cuts=random_cuts)
    assert all(len(t.splits) > 5 for t in cut.tops) and not any(t.splits for t in whole.tops)
    assert len(cut.blocks()) > 3
    path = scratch_path(spark, "forest")
    loaded = fo.ForestModel.load(spark, path, cut.save(path, spark))
    both = whole.predict(df).withColumnRenamed("prediction", "p").join(loaded.predict(df).select("row_key", "prediction"), "row_key")
    rows = both.collect()
    assert len(rows) == 400
    # Sums in another order may choose between splits of equal worth.
    same = [abs(r.p - r.prediction) < 1e-9 for r in rows]
    assert sum(same) >= 396


def test_depth_and_odd_rows(spark):
    rows = [("a", "u", "v", 1.0, None, 2.0), ("b", None, "v", float("nan"), 3.0, 4.0), ("c", "u", None, 1.0, 1.0, None), (None, "w", "v", 5.0, 1.0, 9.0)]
    df = materialise(spark.createDataFrame(rows, "row_key string, c string, d string, x double, y double, label double"))
    model = fo.fit_forest(df, CATS, NUMS, 4, random_cuts=True)
    got = {r.row_key: r.prediction for r in model.predict(df).collect()}
    assert (got["a"], got["b"], got[None]) == (2.0, 4.0, 9.0) and got["c"] is not None
    stump = fo.fit_forest(df, CATS, NUMS, 2, 1, random_cuts=True)
    assert stump.pieces.agg(F.max("nodes")).first()[0] == 3


def test_plan_does_not_grow_with_the_trees(spark, sales):
    rows = materialise(ft.demand_training_set(sales).limit(300))
    sizes = []
    for trees in (2, 40):
        profile = rg.Profile("x", trees=trees, tree_depth=4, boost_rounds=1, adaboost_rounds=1, max_iter=10)
        model = tr.fit_model(rows, ft.DEMAND, "random_forest", profile)
        sizes.append(len(model.predict(rows)._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]


@pytest.mark.parametrize("random_cuts", [False, True])
def test_packed_pieces_are_smaller_and_the_same(random_cuts):
    coder, raw, y = made(300)
    piece = fo.grow(coder, coder.codes(raw), y, np.ones(300), fo.UNLIMITED, random_cuts=random_cuts)
    packed = piece.packed(2)
    again = fo.Piece.unpacked(*packed.values(), 2)
    assert all(np.array_equal(getattr(piece, c), getattr(again, c)) for c in ("feature", "left", "sets"))
    assert sum(map(len, packed.values())) < 0.75 * sum(x.nbytes for x in (piece.feature, piece.number, piece.left, piece.sets))
    np.testing.assert_array_equal(fo.walk(piece, raw, 2), fo.walk(again, raw, 2))


@pytest.mark.parametrize(("random_cuts", "depth"), [(False, None), (True, None), (False, 2)])
def test_trees_dealt_and_scored_a_few_at_a_time_give_the_same_forest(spark, monkeypatch, random_cuts, depth):
    _, raw, y = made(400)
    df = frame(spark, raw, y)
    monkeypatch.setattr(fo, "LOCAL_ROWS", 60)
    whole = fo.fit_forest(df, CATS, NUMS, 5, depth, seed=5, random_cuts=random_cuts)
    want = {r.row_key: r.prediction for r in whole.predict(df).collect()}
    released = []
    monkeypatch.setattr(fo, "DEALT_BYTES", 14_000)
    monkeypatch.setattr(fo, "HELD_BLOCKS", 0)
    monkeypatch.setattr(fo, "release_shuffles", lambda spark: released.append(1))
    few = fo.fit_forest(df, CATS, NUMS, 5, depth, seed=5, random_cuts=random_cuts)
    assert len(released) > 1 and few.pieces.count() == whole.pieces.count()
    # A row twice, an unknown label and missing values are scored as well.
    odd = df.union(df.limit(3)).union(spark.createDataFrame([("odd", "new", None, None, 1.0, 0.0)], df.schema))
    monkeypatch.setattr(few, "_block_sum", None)  # nothing may pass through the driver
    got = few.predict(odd).collect()
    assert len(got) == 404 and sum(abs(want.get(r.row_key, r.prediction) - r.prediction) < 1e-9 for r in got) >= 400
    [lone] = [r.prediction for r in got if r.row_key == "odd"]
    [held] = [r.prediction for r in whole.predict(odd.where("row_key = 'odd'")).collect()]
    assert lone == pytest.approx(held, abs=1e-9)


def test_the_order_by_mean_keeps_equal_means_by_code():
    r = np.random.default_rng(3)
    for _ in range(50):
        node = np.sort(r.integers(0, 9, 60))
        code = np.concatenate([np.arange(n) for n in np.unique(node, return_counts=True)[1]])
        mean = r.integers(0, 4, 60).astype(float)
        np.testing.assert_array_equal(fo._by_mean(node, code, mean), np.lexsort((code, mean, node)))


def test_parted_rows_stand_left_before_right():
    r = np.random.default_rng(4)
    for n in (1, 7):
        parent = np.sort(np.concatenate([np.arange(n), r.integers(0, n, 200)]))
        goes = r.random(len(parent)) < 0.5
        order, child = fo._parted(parent, goes, n)
        want = np.argsort(2 * parent + ~goes, kind="stable")
        np.testing.assert_array_equal(order, want)
        np.testing.assert_array_equal(child, (2 * parent + ~goes)[want])


def test_every_value_is_told_apart_however_many_there_are(spark, monkeypatch):
    """Beyond ``CODES`` values of a number only their quantiles were told apart, and rows between two of them were answered alike."""
    _, raw, y = made(400)
    df = frame(spark, raw, y)
    monkeypatch.setattr(fo, "CODES", 20)
    monkeypatch.setattr(fo, "QUANTILES", 9)
    model = fo.fit_forest(df, CATS, NUMS, 3, seed=5, random_cuts=True)
    got = {r.row_key: r.prediction for r in model.predict(df).collect()}
    _, group = np.unique(raw, axis=0, return_inverse=True)
    means = (np.bincount(group.ravel(), y) / np.bincount(group.ravel()))[group.ravel()]
    np.testing.assert_allclose([got[f"k{i}"] for i in range(400)], means, atol=1e-9)


@pytest.mark.parametrize("random_cuts", [False, True])
def test_large_nodes_are_cut_at_any_value(spark, monkeypatch, random_cuts):
    """Cuts of nodes beyond ``LOCAL_ROWS`` fell on the ends of ``BINS`` bins."""
    _, raw, y = made(400)
    df = frame(spark, raw, y)
    whole = fo.fit_forest(df, CATS, NUMS, 3, seed=5, random_cuts=random_cuts)
    want = {r.row_key: r.prediction for r in whole.predict(df).collect()}
    monkeypatch.setattr(fo, "LOCAL_ROWS", 40)
    monkeypatch.setattr(fo, "BINS", 4)
    monkeypatch.setattr(fo, "GATHERED", 70)
    cut = fo.fit_forest(df, CATS, NUMS, 3, seed=5, random_cuts=random_cuts)
    assert all(len(t.splits) > 5 for t in cut.tops)
    odd = spark.createDataFrame([("odd", "new", None, None, 1.05, 0.0)], df.schema)
    got = {r.row_key: r.prediction for r in cut.predict(df.union(odd)).collect()}
    assert sum(abs(got[k] - want[k]) < 1e-9 for k in want) >= 396
    assert got["odd"] == pytest.approx([r.prediction for r in whole.predict(odd).collect()][0], abs=1e-9)
