import os

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression

from ledgerloom.operators import fourier as fo
from ledgerloom.operators import kernels as kn
from ledgerloom.operators.regressors import KINDS
from ledgerloom.session import shared_folder

GAMMA, SIZE, SEED, REG = 0.3, 6, 42, 0.01


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (200, 2))
    x[::3, 0] = 0.0
    y = np.sin(x[:, 0]) + x[:, 1] + rng.normal(0, 0.2, 200)
    y[::17] += 30.0
    return x, y


def frame(spark, x, y, parts=3):
    made = [Vectors.sparse(2, [(j, float(v)) for j, v in enumerate(a) if v]) if i % 2 else Vectors.dense(a) for i, a in enumerate(x)]
    return spark.createDataFrame([(v, float(b)) for v, b in zip(made, y, strict=True)], ["features", "label"]).repartition(parts).persist()


def test_equals_spark_ml_and_stores_no_mapped_rows(spark, rows, tmp_path):
    x, y = rows
    before = set(os.listdir(shared_folder(spark)))
    model = fo.fit_huber(frame(spark, x, y), 2, GAMMA, SIZE, SEED, REG, 100)
    assert set(os.listdir(shared_folder(spark))) == before
    z = fo.fourier_map(2, GAMMA, SIZE, SEED)(x)
    wide = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(z, y, strict=True)], ["features", "label"])
    want = LinearRegression(loss="huber", regParam=REG, tol=1e-12, maxIter=1000).fit(wide)
    np.testing.assert_allclose(model.weights, want.coefficients.toArray(), rtol=1e-3, atol=1e-4)
    assert model.intercept == pytest.approx(want.intercept, rel=1e-3, abs=1e-4)
    told = model.predict(frame(spark, x, y)).orderBy("label").collect()
    np.testing.assert_allclose([r.prediction for r in told], (z @ model.weights + model.intercept)[np.argsort(y)], rtol=1e-9, atol=1e-9)
    again = KINDS["fourier"].load(spark, str(tmp_path), model.save(str(tmp_path), spark))
    assert [r.prediction for r in again.predict(frame(spark, x, y)).orderBy("label").collect()] == [r.prediction for r in told]


def test_constant_labels_and_partitions(spark, rows):
    x, y = rows
    flat = fo.fit_huber(frame(spark, x[:5], [4.0] * 5), 2, GAMMA, SIZE, SEED, REG, 100)
    assert flat.intercept == pytest.approx(4.0) and not flat.weights.any()
    fits = [fo.fit_huber(frame(spark, x, y, parts), 2, GAMMA, SIZE, SEED, REG, 100) for parts in (1, 70)]
    np.testing.assert_allclose(fits[0].weights, fits[1].weights, rtol=1e-4, atol=1e-5)


def test_the_kernel_machine_stores_no_mapped_rows(spark, rows):
    x, y = rows
    before = set(os.listdir(shared_folder(spark)))
    model = kn.fit_kernel(frame(spark, x[:20], y[:20]), 0.5, 1.0, 4)
    assert set(os.listdir(shared_folder(spark))) == before and model.gap <= kn.GAP * model.objective
