"""Quality classifier: document evidence joined with shrunken site posteriors.

A logistic model of text statistics, trained on labelled rows, gives every
document a probability. Hosts and paths within hosts are then judged by the
soft counts of all their documents (a label counts as certain). Rates are
shrunk by empirical Bayes: a path's toward its host's, a host's toward the
corpus's, with Beta strengths estimated from how much rates vary beyond what
their sizes explain. A sparse site therefore says little. The document's log
odds are moved by the log odds its site adds over the corpus.

Everything after training is grouped sums, so sites may hold any share of the
rows. The model is fitted on at most ``TRAIN_ROWS`` labelled rows, the least by
hash of their id; all other counts cover the whole corpus.

Definitions: null texts are empty. Null hosts and paths are sites of their own.
Labels of unknown documents are ignored, several labels of one id are averaged,
a label outside 0..1 or null is none. Without both labels among the training
rows every document has the rate seen (one half without any). Repeated rows
count as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import outliers
from ledgerloom.llm.common import hinted, typed
from ledgerloom.session import materialise

TRAIN_ROWS = 40_000
RIDGE = 1e-2
STEPS = 30
SITE_WEIGHT = 0.5  # share of the site's log odds a document takes over
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e4
STATS = (*outliers.STATS, "words", "short")


def statistics(counts: Column) -> list[Column]:
    words = F.greatest(counts["n_words"], F.lit(0)).cast("double")
    return [*outliers._statistics(counts), F.log1p(words), F.exp(-words / 25)]


class Logistic:
    """Ridge logistic regression on standardised statistics."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        y = np.asarray(y, float)
        self.centre = x.mean(axis=0) if len(x) else np.zeros(len(STATS))
        scale = x.std(axis=0) if len(x) else np.ones(len(STATS))
        self.scale = np.where(scale > 1e-9, scale, 1.0)
        self.weights = np.zeros(len(STATS) + 1)
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.weights[0] = np.log(rate / (1 - rate))
        if len(y) and 0 < y.mean() < 1:
            z = np.column_stack([np.ones(len(x)), (x - self.centre) / self.scale])
            penalty = np.diag([0.0] + [RIDGE * len(y) / 10] * len(STATS))
            for _ in range(STEPS):  # Newton steps
                p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
                gradient = z.T @ (y - p) - penalty @ self.weights
                curve = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty
                step = np.linalg.solve(curve + 1e-9 * np.eye(len(curve)), gradient)
                self.weights += step
                if np.abs(step).max() < 1e-8:
                    break

    def log_odds(self, stats: list[Column]) -> Column:
        out = F.lit(float(self.weights[0]))
        for s, w, c, d in zip(stats, self.weights[1:], self.centre, self.scale, strict=True):
            out = out + (s - float(c)) * float(w / d)
        return F.greatest(F.least(out, F.lit(12.0)), F.lit(-12.0))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def strength(sites: DataFrame, n: str, rate: str, toward: Column) -> float:
    """Prior sample size of a level, by moments: one row of sums comes to the driver.

    Squared gaps between site rates and their parents' are split into the share
    their sizes explain, r (1 - r) / n, and what is left between sites.
    """
    p = toward
    sums = sites.filter(F.col(n) > 0).select(
        F.sum(F.col(n) * (F.col(rate) - p) ** 2).alias("gap"), F.sum(p * (1 - p)).alias("noise"),
        F.sum(F.col(n) * p * (1 - p)).alias("room"),
    ).first()
    if not sums.room or sums.gap is None:
        return MOST_STRENGTH
    between = max(0.0, sums.gap - sums.noise) / sums.room  # share of the variance that lies between sites
    return float(np.clip((1 - between) / between if between > 0 else MOST_STRENGTH, LEAST_STRENGTH, MOST_STRENGTH))


def fit(scored: DataFrame) -> Logistic:
    """The document model from labelled rows (label, statistics)."""
    rows = scored.filter("label is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    pdf: pd.DataFrame = rows.select("label", *STATS).toPandas()
    return Logistic(pdf[list(STATS)].to_numpy(float), (pdf["label"] >= 0.5).to_numpy(float))


def posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", target: str = "quality") -> DataFrame:
    """doc_id, host, path, p_document, host_rate, path_rate, p_quality, kept of every row."""
    plain = typed(docs, doc_id="bigint", text="string", **{host: "string", path: "string"})
    counted = plain.withColumn("_c", F.arrow_udf(outliers.text_counts, outliers._COUNTS_TYPE)("text"))
    stats = [s.alias(n) for n, s in zip(STATS, statistics(F.col("_c")), strict=True)]
    given = typed(labels, doc_id="bigint", **{target: "double"}).filter(F.col(target).between(0, 1) & F.col("doc_id").isNotNull())
    given = given.groupBy("doc_id").agg(F.avg(target).alias("label"))
    rows = materialise(
        counted.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), *stats).join(given, "doc_id", "left")
    )
    model = fit(rows)
    scored = rows.select(
        "doc_id", "host", "path", "label", model.log_odds([F.col(s) for s in STATS]).alias("evidence")
    ).withColumn("soft", F.coalesce("label", _sigmoid(F.col("evidence"))))
    by_path = materialise(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("soft").alias("good")))
    total = by_path.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = (total.good + 0.5) / (total.n + 1) if total.n else 0.5
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("rate", F.col("good") / F.col("n"))
    by_host = materialise(by_host)
    m_host = strength(by_host, "n", "rate", F.lit(float(overall)))
    host_rate = (F.col("good") + m_host * overall) / (F.col("n") + m_host)
    hosts = materialise(by_host.select(F.col("host").alias("h_host"), host_rate.alias("host_rate")))
    nested = materialise(
        by_path.withColumn("rate", F.col("good") / F.col("n")).join(hosts, F.col("host").eqNullSafe(F.col("h_host"))).drop("h_host")
    )
    m_path = strength(nested, "n", "rate", F.col("host_rate"))
    path_rate = (F.col("good") + m_path * F.col("host_rate")) / (F.col("n") + m_path)
    sites = hinted(nested.select(
        F.col("host").alias("s_host"), F.col("path").alias("s_path"), "host_rate", path_rate.alias("path_rate")
    ))
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path")))
    moved = F.col("evidence") + SITE_WEIGHT * (_logit(F.col("path_rate")) - _logit(F.lit(float(overall))))
    return joined.select(
        "doc_id", "host", "path", _sigmoid(F.col("evidence")).alias("p_document"), "host_rate", "path_rate",
        _sigmoid(moved).alias("p_quality"), (moved >= 0).alias("kept"),
    )
