"""The ten candidate regressors on Spark ML.

Each ``fit_*`` takes a vectorised training frame (row_key, raw columns,
features, label) and returns a fitted model with ``predict(df)`` and
``save(path)``. Deviations from a single-machine library are named in the
docstrings.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.features import Task
from ledgerloom.operators.boosting import BoostedModel, GradientModel, fit_adaboost, fit_gradient
from ledgerloom.operators.forests import ForestModel, fit_forest
from ledgerloom.operators.fourier import FourierModel, fit_huber
from ledgerloom.operators.kernels import KernelModel, fit_kernel
from ledgerloom.operators.neighbours import knn_join
from ledgerloom.session import materialise

SEED = 42


@dataclass(frozen=True)
class Profile:
    """Model sizes. ``REFERENCE`` is the full-size setting, ``COMPACT`` a quick one."""

    name: str
    trees: int
    tree_depth: int | None  # None: trees grow until labels or features are all alike
    boost_rounds: int
    adaboost_rounds: int
    max_iter: int
    fourier_features: int = 128
    landmarks: int = 256


COMPACT = Profile("compact", trees=20, tree_depth=8, boost_rounds=20, adaboost_rounds=10, max_iter=200)
REFERENCE_DEMAND = Profile("reference", trees=400, tree_depth=None, boost_rounds=100, adaboost_rounds=50, max_iter=20_000)
REFERENCE_SALES = Profile("reference", trees=300, tree_depth=None, boost_rounds=100, adaboost_rounds=50, max_iter=20_000)

# The default is the full size.
FULL = {"demand": REFERENCE_DEMAND, "sales": REFERENCE_SALES}

ALPHA, L1_RATIO = 1.0, 0.5
NEIGHBOURS = 7
BOOST_RATE, BOOST_DEPTH = 0.1, 3
SVR_C = 10.0


# -- fitted models -------------------------------------------------------------------------


class SparkModel:
    """A fitted Spark ML pipeline."""

    kind = "pipeline"

    def __init__(self, model: PipelineModel):
        self.model = model

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).select(*df.columns, "prediction")

    def save(self, path: str, spark: SparkSession) -> dict:
        self.model.write().overwrite().save(f"{path}/model")
        return {}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> "SparkModel":
        return cls(PipelineModel.load(f"{path}/model"))


class NeighbourModel:
    """The training rows themselves; a prediction is the mean label of the nearest."""

    kind = "neighbours"

    def __init__(self, rows: DataFrame, cats, nums, k: int):
        self.rows, self.cats, self.nums, self.k = rows, list(cats), list(nums), k

    def predict(self, df: DataFrame) -> DataFrame:
        # Numbered rows: equal or missing keys must not be averaged together.
        rows = materialise(df.withColumn("_row", F.monotonically_increasing_id().cast("string")))
        near = knn_join(rows.drop("row_key").withColumnRenamed("_row", "row_key"), self._keyed(), self.k, self.cats, self.nums)
        means = near.groupBy(F.col("row_key").alias("_row")).agg(F.avg("label").alias("prediction"))
        return rows.join(means, "_row").select(*df.columns, "prediction")

    def _keyed(self) -> DataFrame:
        return self.rows.select("row_key", *self.cats, *self.nums, "label")

    def save(self, path: str, spark: SparkSession) -> dict:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        return {"cats": self.cats, "nums": self.nums, "k": self.k}

    @classmethod
    def load(cls, spark: SparkSession, path: str, meta: dict) -> "NeighbourModel":
        return cls(spark.read.parquet(f"{path}/rows"), meta["cats"], meta["nums"], meta["k"])


KINDS = {c.kind: c for c in (SparkModel, ForestModel, BoostedModel, GradientModel, NeighbourModel, KernelModel, FourierModel)}


def side_by_side(work, items, parallelism: int = 4) -> list:
    """Submit independent Spark jobs from a few driver threads, results in order."""
    with ThreadPool(parallelism) as pool:
        return pool.map(work, items)


# -- fits ----------------------------------------------------------------------------------


def _label_summary(train: DataFrame) -> tuple[int, float]:
    row = train.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("sd")).first()
    return row["n"], row["sd"] or 1.0


def _fit_linear(train: DataFrame, profile: Profile, reg: float, mix: float) -> SparkModel:
    # Scaling changes nothing without a penalty, but a full one-hot block is
    # rank deficient and the solver needs the better conditioning.
    model = LinearRegression(
        regParam=reg, elasticNetParam=mix, standardization=reg == 0.0, maxIter=profile.max_iter, tol=1e-8
    )
    fitted = Pipeline(stages=[model]).fit(train)
    _converged(fitted.stages[0], profile)
    return SparkModel(fitted)


def _converged(model: LinearRegressionModel, profile: Profile) -> LinearRegressionModel:
    """The model, if its solver stopped before the limit of iterations."""
    if model.hasSummary and model.summary.totalIterations >= profile.max_iter:
        raise RuntimeError(f"no convergence within {profile.max_iter} iterations")
    return model


def fit_linear(train: DataFrame, task: Task, profile: Profile) -> SparkModel:
    return _fit_linear(train, profile, 0.0, 0.0)


def fit_ridge(train: DataFrame, task: Task, profile: Profile) -> SparkModel:
    """The penalty is scaled to a sum-of-squares loss: Spark divides the loss by
    the row count and the squared penalty by the label's deviation."""
    n, sd = _label_summary(train)
    return _fit_linear(train, profile, ALPHA * sd / n, 0.0)


def fit_lasso(train: DataFrame, task: Task, profile: Profile) -> SparkModel:
    return _fit_linear(train, profile, ALPHA, 1.0)


def fit_elastic_net(train: DataFrame, task: Task, profile: Profile) -> SparkModel:
    _, sd = _label_summary(train)
    flat, square = ALPHA * L1_RATIO, ALPHA * (1 - L1_RATIO) * sd
    return _fit_linear(train, profile, flat + square, flat / (flat + square))


def fit_random_forest(train: DataFrame, task: Task, profile: Profile) -> ForestModel:
    return fit_forest(train, task.cats, task.nums, profile.trees, profile.tree_depth, seed=SEED)


def fit_random_cut_forest(train: DataFrame, task: Task, profile: Profile) -> ForestModel:
    """Extremely randomised trees: a cut point is drawn per node and number."""
    return fit_forest(train, task.cats, task.nums, profile.trees, profile.tree_depth, seed=SEED, random_cuts=True)


def fit_gbt(train: DataFrame, task: Task, profile: Profile) -> GradientModel:
    """Gradient boosting with squared loss on the forests' core."""
    return fit_gradient(train, task.cats, task.nums, profile.boost_rounds, BOOST_DEPTH, BOOST_RATE, seed=SEED)


def fit_adaboost_r2(train: DataFrame, task: Task, profile: Profile) -> BoostedModel:
    """AdaBoost.R2 with linear loss on weighted resamples."""
    return fit_adaboost(train, task.cats, task.nums, profile.adaboost_rounds, BOOST_DEPTH, seed=SEED)


def fit_knn(train: DataFrame, task: Task, profile: Profile) -> NeighbourModel:
    return NeighbourModel(train.select("row_key", *task.cats, *task.nums, "label"), task.cats, task.nums, NEIGHBOURS)


def _kernel_width(train: DataFrame, task: Task) -> float:
    """gamma: one over the number of vector entries times the variance of them all."""
    width = len(train.select("features").first()[0])
    # Spread over all vector entries: each one-hot group adds one 1 per row.
    sums = train.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s_{c}") for c in task.nums],
        *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in task.nums],
    ).first()
    entries = sums["n"] * width
    mean = (sum(sums[f"s_{c}"] for c in task.nums) + sums["n"] * len(task.cats)) / entries
    square = (sum(sums[f"q_{c}"] for c in task.nums) + sums["n"] * len(task.cats)) / entries
    return 1.0 / (width * max(square - mean * mean, 1e-12))


def fit_rbf_svr(train: DataFrame, task: Task, profile: Profile) -> KernelModel:
    """The kernel support vector machine on ``profile.landmarks`` landmarks, to a proven duality gap."""
    return fit_kernel(train, _kernel_width(train, task), SVR_C, profile.landmarks)


def fit_rbf_huber(train: DataFrame, task: Task, profile: Profile) -> FourierModel:
    """The same kernel through random features, with a Huber loss; not one of the ten."""
    width = len(train.select("features").first()[0])
    gamma = _kernel_width(train, task)
    return fit_huber(train, width, gamma, profile.fourier_features, SEED, 1.0 / (SVR_C * train.count()), profile.max_iter)


# In listing order, which breaks ties in the comparison.
CANDIDATES = {
    "linear": fit_linear,
    "ridge": fit_ridge,
    "lasso": fit_lasso,
    "elastic_net": fit_elastic_net,
    "random_forest": fit_random_forest,
    "random_cut_forest": fit_random_cut_forest,
    "gbt": fit_gbt,
    "adaboost_r2": fit_adaboost_r2,
    "knn": fit_knn,
    "rbf_svr": fit_rbf_svr,
}
# Fitted by name, but not compared.
EXTRAS = {"rbf_huber": fit_rbf_huber}

