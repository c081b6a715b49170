import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from ledgerloom.operators import kernels as kn

COST, GAMMA = 10.0, 0.5


def frame(spark, x, y, parts=3):
    rows = [(Vectors.dense(a), float(b)) for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, ["features", "label"]).repartition(parts)


def dual_by_pairs(kernel, y, cost, rounds):
    """The dual's maximum by moving one pair of coefficients at a time, their sum staying zero."""
    rng = np.random.default_rng(0)
    alpha = np.zeros(len(y))
    value = lambda a: y @ a - kn.EPSILON * np.abs(a).sum() - 0.5 * a @ kernel @ a
    for _ in range(rounds):
        i, j = rng.choice(len(y), 2, replace=False)
        low, high = max(-cost - alpha[i], alpha[j] - cost), min(cost - alpha[i], alpha[j] + cost)
        bend = kernel[i, i] + kernel[j, j] - 2 * kernel[i, j]
        pull = (y[i] - kernel[i] @ alpha) - (y[j] - kernel[j] @ alpha)
        stops = [low, high, -alpha[i], alpha[j]]
        if bend > 0:
            stops += [(pull - kn.EPSILON * s) / bend for s in (-2, 0, 2)]
        t = np.unique(np.clip(stops, low, high))
        gain = t * pull - 0.5 * bend * t * t - kn.EPSILON * (np.abs(alpha[i] + t) + np.abs(alpha[j] - t))
        step = t[int(np.argmax(gain))]
        alpha[i] += step
        alpha[j] -= step
    return value(alpha)


@pytest.fixture(scope="module")
def curve():
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, (40, 2))
    return x, 3 * np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(0, 0.3, 40)


def test_equals_the_exact_machine_where_all_rows_are_landmarks(spark, curve):
    x, y = curve
    model = kn.fit_kernel(frame(spark, x, y), GAMMA, COST, 64)
    best = dual_by_pairs(kn.gaussian(x, x, GAMMA), y, COST, 60_000)
    assert 0 <= model.gap <= kn.GAP * model.objective
    assert best <= model.objective * (1 + 1e-9) and model.objective <= best * (1 + 2 * kn.GAP) + 1e-6
    told = {tuple(r.features): r.prediction for r in model.predict(frame(spark, x, y)).collect()}
    want = kn.gaussian(x, model.landmarks, GAMMA) @ model.weights + model.intercept
    np.testing.assert_allclose([told[tuple(a)] for a in x], want)
    norm = model.weights @ kn.gaussian(model.landmarks, model.landmarks, GAMMA) @ model.weights
    again = 0.5 * norm + COST * np.maximum(np.abs(y - want) - kn.EPSILON, 0).sum()
    assert again == pytest.approx(model.objective, rel=1e-6)


def test_few_landmarks_and_partitions_do_not_matter(spark, curve):
    x, y = curve
    fits = [kn.fit_kernel(frame(spark, x, y, parts), GAMMA, COST, 8) for parts in (1, 7, 80)]
    assert all(len(f.weights) == 8 and f.gap <= kn.GAP * f.objective for f in fits)
    for other in fits[1:]:
        assert other.landmarks.tolist() == fits[0].landmarks.tolist()
        assert other.objective == pytest.approx(fits[0].objective, rel=kn.GAP)


def test_alike_rows_and_constant_labels(spark):
    flat = kn.fit_kernel(frame(spark, [[1.0], [1.0], [2.0]], [4.0, 4.0, 4.0]), GAMMA, COST, 8)
    assert [r.prediction for r in flat.predict(frame(spark, [[1.0], [9.0]], [0, 0])).collect()] == pytest.approx([4.0, 4.0])
    one = kn.fit_kernel(frame(spark, [[1.0]] * 5, [1.0, 2.0, 3.0, 3.0, 9.0]), GAMMA, COST, 8)
    assert one.predict(frame(spark, [[1.0]], [0])).first().prediction == pytest.approx(3.0, abs=kn.EPSILON + 1e-2)


def test_a_full_step_that_helps_takes_one_pass(spark, curve, monkeypatch):
    """Each step took a second pass for other lengths, and vectors were unpacked anew in every pass."""
    x, y = curve
    passes, packs = [], []
    summed, packed = kn.summed, kn.packed
    monkeypatch.setattr(kn, "summed", lambda blocks, width, work, rows: passes.append(rows) or summed(blocks, width, work, rows))
    monkeypatch.setattr(kn, "packed", lambda train, width: packs.append(1) or packed(train, width))
    model = kn.fit_kernel(frame(spark, x, y), GAMMA, COST, 64)
    assert model.gap <= kn.GAP * model.objective
    assert len(packs) == 1 and passes.count(1) < 0.34 * len(passes)


def test_smoothed_losses_are_the_quadratic_piece_then_lines():
    left, delta = np.linspace(-3, 3, 25)[:, None] * np.array([1.0, 0.2]), 0.7
    over = np.maximum(np.abs(left) - kn.EPSILON, 0.0)
    want = np.where(over < delta, over * over / (2 * delta), over - delta / 2).sum(axis=0)
    np.testing.assert_allclose(kn._losses(left.copy(), delta), want)
