"""Source divergence audit by count-cell ranking.

Per language, the terms found in at least ``MIN_DOCS`` of its documents are
kept. Every (lang, source) group, and the language as a whole, gives each kept
term a smoothed share in parts of ``SCALE``. ``f = floor((p - q)^2 / q)`` says
how far a group's share p stands from another share q.

``term`` ranks a group's overrepresented terms against its language. A share
depends on two counts alone, so terms are grouped by (group count, lang count)
cells, f is evaluated once a cell, equal values are merged, and values are
ranked by cumulative multiplicity. Only the cells that reach the first
``TOP_TERMS`` places are expanded into terms, in UTF-8 order within a value.

``pair`` ranks the other sources of the language by f summed over all kept
terms. Most terms are absent from most sources, so the sum is put together from
cells: both absent (one value times the number of terms), one present (cells of
a single source, by count), and a correction where both are present. The last
part walks each term's list of sources in blocks and hands on sums per pair of
sources only.

All arithmetic is in whole numbers. Null text, lang and source count as ''.
Each row is a document, rows that repeat too; extra columns are ignored. A
group without kept terms has 0 towards every source if its language keeps none,
and smoothed shares else. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.common import hinted, typed
from ledgerloom.session import materialise

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
PAIRS_HELD = 1 << 20  # pairs of entries worked on at once, and sums held by a task

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """Terms of a text as an array: runs of ASCII letters and all beyond ASCII, only A-Z lower-cased."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _documents(docs: DataFrame) -> DataFrame:
    kept = typed(docs, text="string", lang="string", source="string")
    return kept.select(*[F.coalesce(c, F.lit("")).alias(c) for c in kept.columns])


def term_vectors(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """row, lang, term, total, at: each kept term with its (source, n) list.

    A document's terms are counted once with and once without repeats, both
    added up before the shuffle. A list has one entry a source.
    """
    texts = _documents(docs).select("lang", "source", terms_of(F.col("text")).alias("all"))
    ways = F.array(
        F.struct(F.col("all").alias("terms"), F.lit(0).alias("once")),
        F.struct(F.array_distinct("all").alias("terms"), F.lit(1).alias("once")),
    )
    each = (
        texts.select("lang", "source", F.explode(ways).alias("w"))
        .select("lang", "source", "w.once", F.explode("w.terms").alias("term"))
        .groupBy("lang", "source", "term")
        .agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))
    )
    return (
        each.groupBy("lang", "term")
        .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("at"))
        .where(F.col("docs") >= min_docs)
        .select(F.monotonically_increasing_id().alias("row"), "lang", "term", "total", "at")
    )


def _counts(vectors: DataFrame) -> DataFrame:
    return vectors.select("row", "lang", "term", "total", F.explode("at").alias("e")).select(
        "row", "lang", "term", "total", "e.source", "e.n"
    )


def group_sizes(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """lang, source, no, size, v, lang_size: every occurring group, numbered within its language."""
    groups = _documents(docs).select("lang", "source").distinct()
    own = _counts(vectors).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    whole = vectors.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
    zero = F.lit(0).cast("long")
    return groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").select(
        "lang", "source", F.row_number().over(W.partitionBy("lang").orderBy("source")).alias("no"),
        *[F.coalesce(c, zero).alias(c) for c in ("size", "v", "lang_size")],
    )


def _share(n: str, size: str, v: str = "v") -> Column:
    """1 + floor(SCALE * (n + 1) / (size + v)); beyond 64 bits in decimals."""
    quick = f"({n} + 1) * {SCALE} div ({size} + {v})"
    wide = f"cast({n} + 1 as decimal(20, 0)) * {SCALE} div cast({size} + {v} as decimal(20, 0))"
    return F.expr(f"1 + case when {n} < 9000000000 then {quick} else {wide} end")


def _far(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def term_ranks(vectors: DataFrame, sizes: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, item, value, rank: each group's terms above their language's share."""
    counts = _counts(vectors)
    cell = ["lang", "source", "n", "total"]
    cells = (
        counts.groupBy(*cell)
        .agg(F.count("*").alias("m"))
        .join(sizes, ["lang", "source"])
        .withColumns({"p": _share("n", "size"), "q": _share("total", "lang_size")})
        .where("p > q")
        .select(*cell, "m", _far("p", "q").alias("value"))
    )
    cells = materialise(cells)
    group = W.partitionBy("lang", "source")
    # Each value has a term at least, so the first `top` values hold the first `top` places.
    merged = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    first = merged.withColumn("k", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("k") <= top)
    before = F.sum("m").over(group.orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, -1))
    reached = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < top)
    wanted = hinted(cells.join(reached.select("lang", "source", "value"), ["lang", "source", "value"]).select(*cell, "value"))
    rank = F.row_number().over(group.orderBy(F.desc("value"), "item"))
    return (
        counts.join(wanted, cell)
        .select("lang", "source", F.col("term").alias("item"), "value")
        .withColumn("rank", rank)
        .where(F.col("rank") <= top)
    )


def _joint_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (lang, a, b): what terms present in both add beyond the cells of each alone."""
    held: dict[tuple[str, int, int], int] = {}

    def given() -> pa.RecordBatch:
        lang, a, b = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(held.values()), pa.int64())],
            ["lang", "a", "b", "joint"],
        )

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        lists = batch.column("at")
        entries = lists.flatten()
        no, p, zero = (entries.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        count = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(count) - count
        of_lang = langs.indices.to_numpy(zero_copy_only=False)
        # The left entries of all pairs, in runs of at most PAIRS_HELD pairs (or one entry's).
        left = np.arange(len(no))
        row = np.repeat(np.arange(len(count)), count)
        ahead = np.cumsum(count[row])
        done = 0
        while done < len(left):
            base = ahead[done - 1] if done else 0
            end = max(int(np.searchsorted(ahead, base + PAIRS_HELD, "right")), done + 1)
            here = left[done:end]
            width = count[row[here]]
            i = np.repeat(here, width)
            within = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
            j = begin[row[i]] + within
            apart = i != j
            i, j = i[apart], j[apart]
            done = end
            if not len(i):
                continue
            def far(x, y):
                return (x - y) * (x - y) // y

            value = far(p[i], p[j]) - far(p[i], zero[j]) - far(zero[i], p[j]) + far(zero[i], zero[j])
            key = np.stack([of_lang[row[i]], no[i], no[j]], axis=1)
            order = np.lexsort(key.T[::-1])
            key, value = key[order], value[order]
            heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            names = langs.dictionary.to_pylist()
            for (k, a, b), s in zip(key[heads].tolist(), np.add.reduceat(value, heads).tolist(), strict=True):
                held[names[k], a, b] = held.get((names[k], a, b), 0) + s
            if len(held) > PAIRS_HELD:
                yield given()
                held.clear()
    if held:
        yield given()


def pair_ranks(vectors: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: each group's other sources by summed f."""
    zeroed = sizes.withColumn("zero", F.when(F.col("v") > 0, _share("0L", "size")).otherwise(F.lit(1).cast("long")))
    zeroed = hinted(zeroed.select("lang", "source", "no", "size", "v", "zero"))
    counts = _counts(vectors).join(zeroed, ["lang", "source"])
    shared = counts.withColumn("p", _share("n", "size"))
    lists = shared.groupBy("row", "lang").agg(F.collect_list(F.struct("no", "p", "zero")).alias("at"))
    joint = (
        lists.where(F.size("at") > 1)
        .select("lang", "at")
        .mapInArrow(_joint_sums, "lang string, a int, b int, joint long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("joint").alias("joint"))
    )
    # Cells of one source: how many of its terms have which share.
    cells = hinted(shared.groupBy("lang", F.col("no").alias("a"), "p").agg(F.count("*").alias("m")))
    one, two = (zeroed.select("lang", *[F.col(c).alias(f"{side}_{c}") for c in ("no", "source", "v", "zero")]) for side in "ab")
    grid = (
        one.join(two, "lang")
        .where("a_no <> b_no")
        .select("lang", F.col("a_no").alias("a"), F.col("b_no").alias("b"), "a_source", "b_source", "a_v", "a_zero", "b_zero")
        .withColumn("neither", _far("a_zero", "b_zero"))
    )
    side = grid.select("lang", "a", "b", "a_zero", "b_zero", "neither")
    only_a = side.join(cells, ["lang", "a"]).select("lang", "a", "b", (F.col("m") * (_far("p", "b_zero") - F.col("neither"))).alias("add"))
    only_b = side.join(cells.withColumnRenamed("a", "b"), ["lang", "b"]).select(
        "lang", "a", "b", (F.col("m") * (_far("a_zero", "p") - F.col("neither"))).alias("add")
    )
    parts = only_a.union(only_b).groupBy("lang", "a", "b").agg(F.sum("add").alias("single"))
    zero = F.lit(0).cast("long")
    value = F.col("a_v") * F.col("neither") + F.coalesce("single", zero) + F.coalesce("joint", zero)
    key = ["lang", "a", "b"]
    valued = grid.join(parts, key, "left").join(joint, key, "left").select(
        "lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), value.alias("value")
    )
    return valued.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    vectors = materialise(term_vectors(docs, min_docs))
    sizes = hinted(group_sizes(docs, vectors))
    pairs, terms = pair_ranks(vectors, sizes), term_ranks(vectors, sizes, top)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")
    )
