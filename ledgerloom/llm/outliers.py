"""Quality rules: base counts, then robust multivariate outliers per language and source.

Each text becomes a short vector of transformed statistics. Per (lang, source)
the location and scatter come from a minimum covariance determinant estimate:
the ``SUBSET`` share of vectors whose covariance has the least determinant,
found by concentration steps from three deterministic starts. A step is one
grouped quantile of the Mahalanobis distances and one grouped sum of products
over all rows, so a group may hold any share of the corpus. Vectors beyond the
chi-square cutoff are rejected.

Groups below ``MIN_GROUP`` rows use their language's estimate, and languages
below it the whole corpus's. Each statistic has a floor for its spread, so a
statistic that is constant in the subset (no symbols at all) does not turn
every small deviation into an outlier.

Definitions: words are the runs of non-white-space; null and empty texts have
none, fail the base rules and take no part in the estimates. Null languages or
sources are groups of their own. Repeated rows count as often as they occur
and get equal verdicts; extra columns are ignored, or kept by ``drop_rejected``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textvec as tv
from ledgerloom.llm.common import boxed, column, hinted, typed
from ledgerloom.session import materialise

MIN_WORDS = 50
SUBSET = 0.75
STEPS = 4
MIN_GROUP = 200
QUANTILE_ACCURACY = 2000

# Statistic, and the least standard deviation it is given.
FLOORS = {
    "word_length": 0.10,  # log of code points per word
    "symbols": 0.05,  # square root of symbols per code point in words
    "lines": 0.20,  # square root of repeated lines per line
    "repeats": 0.15,  # square root of repeated words per word
    "capitals": 0.08,  # square root of capitals per code point in words
    "marks": 0.08,  # square root of other ASCII punctuation per code point in words
}
STATS = tuple(FLOORS)
D = len(STATS)
# 0.99999 quantile of chi-square with 6 degrees of freedom: about one clean text
# in 100,000 of a normal group is rejected.
CUTOFF = 34.0
# Scatter of the central 75 % of a 6-dimensional normal, relative to the whole.
CONSISTENCY = 1 / 0.6763

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_COUNTS_TYPE = "struct<" + ",".join(f"{c}:bigint" for c in (*COUNTS, "n_lines", "n_capitals", "n_marks")) + ">"

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = 1
_CAPITAL = np.zeros(256, np.uint8)
_CAPITAL[0x41:0x5B] = 1
_MARK = np.zeros(256, np.uint8)
_MARK[0x21:0x30] = _MARK[0x3A:0x41] = _MARK[0x5B:0x61] = _MARK[0x7B:0x7F] = 1
_MARK[_SYMBOL > 0] = 0
_HEAD = np.ones(256, np.uint8)
_HEAD[0x80:0xC0] = 0  # UTF-8 continuation bytes


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def count_slice(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The counts of ``_COUNTS_TYPE`` for the texts of one slice."""
    n = len(offsets) - 1
    hashes = tv.PrimeHashes(data)
    in_word = tv.SPACES[data]
    starts, ends = tv.runs(in_word, offsets)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    words = hashes.of(starts, ends)

    # Words inside a three-word window that occurs twice or more in its text.
    hit = np.zeros(len(words) + 1, np.int64)
    if len(words) >= 3:
        row = tv.owners(n_words)
        at = np.flatnonzero(row[2:] == row[:-2])
        keys = words[at] * tv._STEPS[0] + words[at + 1] * tv._STEPS[1] + words[at + 2] * tv._STEPS[2]
        twice = at[tv.repeated(keys, row[at]) > 1]
        np.add.at(hit, twice, 1)
        np.add.at(hit, np.minimum(twice + 3, len(words)), -1)
    covered = (np.cumsum(hit)[:-1] > 0).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(covered)])
    n_repeat = sums[first[1:]] - sums[first[:-1]]

    # Lines with a word that equal an earlier line: rows less distinct keys.
    breaks = np.flatnonzero(data == 0x0A)
    line_row = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.argsort(line_start, kind="stable")
    # An empty text's line and the next text's first line start alike; both are empty or in row order.
    line_row, line_start = line_row[order], line_start[order]
    line_end = np.minimum(np.concatenate([line_start[1:], [len(data)]]), offsets[line_row + 1])
    is_cut = np.zeros(len(data) + 1, bool)
    is_cut[breaks] = True
    tail = (line_end > line_start) & is_cut[np.maximum(line_end - 1, 0)]
    line_end = line_end - tail
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    keys, rows = hashes.of(line_start[has_word], line_end[has_word]), line_row[has_word]
    salted = tv.mix(keys ^ tv.mix(rows.astype(np.uint64) + np.uint64(1)))
    _, seen = np.unique(salted, return_index=True)
    n_dup = np.bincount(rows, minlength=n) - np.bincount(rows[seen], minlength=n)

    return [
        n_words,
        _per_text(_HEAD[data] * in_word, offsets),
        _per_text(_SYMBOL[data], offsets),
        n_dup,
        n_repeat,
        np.bincount(rows, minlength=n),
        _per_text(_CAPITAL[data], offsets),
        _per_text(_MARK[data], offsets),
    ]


def text_counts(texts: pa.Array) -> pa.Array:
    names = (*COUNTS, "n_lines", "n_capitals", "n_marks")
    parts = [count_slice(data, offsets) for _, data, offsets in tv.text_slices(texts)]
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(len(names))]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def _statistics(c: Column) -> list[Column]:
    chars = F.greatest(c["word_chars"], F.lit(1)).cast("double")
    words = F.greatest(c["n_words"], F.lit(1)).cast("double")
    return [
        F.log(chars / words),
        F.sqrt(c["n_symbols"] / chars),
        F.sqrt(c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1))),
        F.sqrt(c["n_repeat_words"] / words),
        F.sqrt(c["n_capitals"] / chars),
        F.sqrt(c["n_marks"] / chars),
    ]


def _with_counts(docs: DataFrame) -> DataFrame:
    # Not told to be deterministic: else a filter on the counts has each text counted twice, in two workers at once.
    counted = F.arrow_udf(text_counts, _COUNTS_TYPE).asNondeterministic()
    return docs.withColumn("_counts", counted(docs["text"].cast("string")))


GROUP = ["level", "lang", "source"]


def _vectors(docs: DataFrame) -> DataFrame:
    """lang, source and statistics of every text that passes the base rules, written once."""
    plain = _with_counts(typed(docs, lang="string", source="string", text="string"))
    kept = plain.filter(~base_failed(F.col("_counts")))
    stats = [s.alias(n) for n, s in zip(STATS, _statistics(F.col("_counts")), strict=True)]
    return materialise(kept.select("lang", "source", *stats))


def _levels(vectors: DataFrame) -> DataFrame:
    """Each vector under its group, its language and the corpus, where those are used."""
    null = F.lit(None).cast("string")
    n_group = vectors.groupBy("lang", "source").agg(F.count("*").alias("n"))
    n_lang = n_group.groupBy("lang").agg(F.sum("n").alias("n"))
    levels = (
        n_group.filter(F.col("n") >= MIN_GROUP).select(F.lit(0).alias("level"), "lang", "source")
        .union(n_lang.filter(F.col("n") >= MIN_GROUP).select(F.lit(1), "lang", null))
    )
    wanted = hinted(levels)
    rows = vectors.select(
        "*", F.explode(F.array(
            F.struct(F.lit(0).alias("level"), F.col("lang").alias("g_lang"), F.col("source").alias("g_source")),
            F.struct(F.lit(1).alias("level"), F.col("lang").alias("g_lang"), null.alias("g_source")),
            F.struct(F.lit(2).alias("level"), null.alias("g_lang"), null.alias("g_source")),
        )).alias("g"),
    ).select("g.level", F.col("g.g_lang").alias("lang"), F.col("g.g_source").alias("source"), *STATS)
    named = rows.filter("level < 2").join(
        wanted.select(F.col("level").alias("w_level"), F.col("lang").alias("w_lang"), F.col("source").alias("w_source")),
        (F.col("level") == F.col("w_level")) & F.col("lang").eqNullSafe(F.col("w_lang")) & F.col("source").eqNullSafe(F.col("w_source")),
        "left_semi",
    )
    return named.union(rows.filter("level = 2"))


_PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def _moments(rows: DataFrame, key: list[str], values: list[Column]) -> DataFrame:
    """Per group: n, and arrays of sums and of products (upper triangle)."""
    return rows.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(v) for v in values]).alias("s"),
        F.array(*[F.sum(values[i] * values[j]) for i, j in _PAIRS]).alias("p"),
    )


def estimate(n: float, s, p, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, precision and log determinant from moments, spread floors applied."""
    mean = np.asarray(s, float) / n
    cov = np.zeros((D, D))
    for (i, j), value in zip(_PAIRS, p, strict=True):
        cov[i, j] = cov[j, i] = value / n - mean[i] * mean[j]
    cov = cov * scale + np.diag(np.square(list(FLOORS.values())))
    return mean, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def _fit(moments: DataFrame, key: list[str], scale: float) -> DataFrame:
    """One small row per group and start; the work is a 6 x 6 inverse each."""

    def solve(batches):
        for pdf in batches:
            rows = [estimate(r.n, r.s, r.p, scale) for r in pdf.itertuples()]
            out = pdf[key].copy()
            out["mean"] = [r[0].tolist() for r in rows]
            out["precision"] = [r[1].ravel().tolist() for r in rows]
            out["logdet"] = [r[2] for r in rows]
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in moments.schema.fields}
    schema = ",".join(f"`{k}` {kinds[k]}" for k in key) + ", mean array<double>, precision array<double>, logdet double"
    return moments.mapInPandas(solve, schema)


def distance(values: list[Column], mean: Column, precision: Column) -> Column:
    """Squared Mahalanobis distance as one expression."""
    gap = [v - mean[i] for i, v in enumerate(values)]
    out = F.lit(0.0)
    for i, j in _PAIRS:
        out = out + gap[i] * gap[j] * precision[i * D + j] * (1.0 if i == j else 2.0)
    return out


def _beside(rows: DataFrame, params: DataFrame, key: list[str]) -> DataFrame:
    renamed = hinted(params).select(*[F.col(k).alias(f"_p_{k}") for k in key], *[c for c in params.columns if c not in key])
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k).eqNullSafe(F.col(f"_p_{k}")) if k in ("lang", "source") else F.col(k) == F.col(f"_p_{k}"))
    return rows.join(renamed, same).drop(*[f"_p_{k}" for k in key])


def scatter(vectors: DataFrame) -> DataFrame:
    """level, lang, source, mean, precision: the estimate of every group in use."""
    rows = materialise(_levels(vectors))
    columns = [F.col(c) for c in STATS]
    half = [F.percentile_approx(c, 0.5, QUANTILE_ACCURACY) for c in STATS]
    medians = rows.groupBy(*GROUP).agg(F.array(*half).alias("median"))
    centred = _beside(rows, medians, GROUP)
    spread = [F.percentile_approx(F.abs(F.col(c) - F.col("median")[i]), 0.5, QUANTILE_ACCURACY) for i, c in enumerate(STATS)]
    mads = materialise(centred.groupBy(*GROUP).agg(F.first("median").alias("median"), F.array(*spread).alias("mad")))

    # Start 0: classical moments. Start 1: median and deviation, no correlation.
    # Start 2: moments of values pulled in to three deviations of the median.
    robust = _beside(rows, mads, GROUP)
    unit = [F.greatest(1.4826 * F.col("mad")[i], F.lit(f)) for i, f in enumerate(FLOORS.values())]
    pulled = [
        F.greatest(F.least(c, F.col("median")[i] + 3 * unit[i]), F.col("median")[i] - 3 * unit[i])
        for i, c in enumerate(columns)
    ]
    start_key = [*GROUP, "start"]
    classic = _moments(rows.withColumn("start", F.lit(0)), start_key, columns)
    pulled_in = _moments(robust.withColumn("start", F.lit(2)), start_key, pulled)
    plain = mads.select(
        *GROUP, F.lit(1).alias("start"), F.lit(1).cast("long").alias("n"), F.col("median").alias("s"),
        F.array(*[
            F.col("median")[i] * F.col("median")[j] + (unit[i] * unit[i] if i == j else F.lit(0.0)) for i, j in _PAIRS
        ]).alias("p"),
    )
    params = _fit(classic.unionByName(plain).unionByName(pulled_in), start_key, 1.0)
    started = rows.select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("start"))
    for _ in range(STEPS):
        far = _beside(started, params, start_key).withColumn("d2", distance(columns, F.col("mean"), F.col("precision")))
        bounds = far.groupBy(*start_key).agg(F.percentile_approx("d2", SUBSET, QUANTILE_ACCURACY).alias("bound"))
        near = _beside(far.drop("mean", "precision", "logdet"), bounds, start_key).filter("d2 <= bound")
        params = materialise(_fit(_moments(near, start_key, columns), start_key, CONSISTENCY))
    best = params.groupBy(*GROUP).agg(F.min_by(F.struct("mean", "precision"), F.struct("logdet", "start")).alias("b"))
    return materialise(best.select(*GROUP, "b.mean", "b.precision"))


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` (text, lang, source and what goes with them) with _counts,
    _failed (base rules), _distance (null if failed) and _kept beside."""
    params = scatter(_vectors(docs))

    def level(n: int, key: dict[str, str]) -> DataFrame:
        chosen = params.filter(F.col("level") == n)
        return hinted(chosen.select(*[F.col(k).alias(f"_{n}_{k}") for k in key], F.struct("mean", "precision").alias(f"_{n}")))

    lang = docs["lang"] if "lang" in docs.columns else F.lit(None)
    source = docs["source"] if "source" in docs.columns else F.lit(None)
    out = _with_counts(docs)
    out = out.join(level(0, {"lang": "", "source": ""}), lang.eqNullSafe(F.col("_0_lang")) & source.eqNullSafe(F.col("_0_source")), "left")
    out = out.join(level(1, {"lang": ""}), lang.eqNullSafe(F.col("_1_lang")), "left")
    out = out.join(level(2, {}), F.lit(True), "left")  # one row at most: the corpus
    fit = F.coalesce("_0", "_1", "_2")
    failed = base_failed(F.col("_counts"))
    d2 = distance(_statistics(F.col("_counts")), fit["mean"], fit["precision"])
    return (
        out.withColumn("_failed", failed)
        .withColumn("_distance", F.when(~failed, d2))
        .withColumn("_kept", ~failed & F.coalesce(F.col("_distance") <= CUTOFF, F.lit(True)))
    )


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, distance."""
    out = judged(typed(docs, doc_id="bigint", text="string", lang="string", source="string"))
    return out.select(
        "doc_id", *[F.col("_counts")[c].alias(c) for c in COUNTS], F.col("_failed").alias("base_failed"),
        F.col("_kept").alias("kept"), F.col("_distance").alias("distance"),
    )


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns."""
    parts = {name: column(docs, name, "string") for name in ("text", "lang", "source")}
    return judged(boxed(docs, **parts)).filter("_kept").select("row.*")
