"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item is cut into windows of ``size`` consecutive words. The words
of a window are ordered by rarity over the whole corpus; full containment needs
every word of the window, so the rarest one (the necessary prefix of length
one) must occur in the document. Documents meet windows on that word alone, the
word's place in the window bounds where the window would start and end in the
document, and the candidate is verified word by word.

Definitions: words are lower-cased (A-Z only) runs of digits, ASCII letters and
all characters beyond ASCII. A window of an item with fewer than ``size`` words,
but not none, is the whole item. Null and empty texts have no words. Items that
repeat count once per item id; a null item id is reported as no id. Documents
are told apart by (doc_id, text): repeated rows get equal results, and all
extra columns are ignored. Empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small, text_key, typed
from ledgerloom.session import materialise

WINDOW = 13
MIN_SHARE = 20  # contaminated when the hit words are at least one in so many

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text as an array. Pure ASCII texts take the fast lower()."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, _BETWEEN), ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, window (array of words): each distinct window of each item."""
    words = typed(benchmark, item_id="bigint", text="string").select("item_id", words_of(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    return (
        words.filter(F.size("words") > 0)
        .select("item_id", "words", F.explode(starts).alias("start"))
        .select("item_id", F.slice("words", F.col("start") + 1, size).alias("window"))
        .distinct()
    )


def _documents(docs: DataFrame) -> DataFrame:
    return typed(docs, doc_id="bigint", text="string").select(
        "doc_id", text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("words")
    )


def rarest_words(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """windows with their prefix: the rarest word (anchor) and its place (offset).

    Every word of the corpus that occurs in some window is counted; ties go to
    the word that sorts first, repeated words of a window to the first place.
    """
    wanted, fits = small(windows.select(F.explode("window").alias("word")).distinct())
    seen = documents.select(F.explode("words").alias("word"))
    counts = seen.join(F.broadcast(wanted) if fits else wanted, "word").groupBy("word").agg(F.count("*").alias("n"))
    placed = windows.select("window").distinct().select("window", F.posexplode("window").alias("offset", "word"))
    return (
        placed.join(counts, "word", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("p"))
        .select("window", F.col("p.word").alias("anchor"), F.col("p.offset").alias("offset"))
    )


def window_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, text_key, start, stop, item_id: every occurrence of every window."""
    documents = _documents(docs)
    windows = materialise(item_windows(benchmark, size))
    anchored, fits = small(rarest_words(documents, windows))
    begin = F.col("place") - F.col("offset")
    if fits:
        # The text's words stay in the row; only rows that meet an anchor are copied.
        met = documents.select("doc_id", "text_key", "words", F.posexplode("words").alias("place", "anchor")).join(
            F.broadcast(anchored), "anchor"
        )
        occurs = F.slice("words", begin + 1, F.size("window"))
    else:
        # Windows beyond a broadcast: only the words around each place travel.
        around = F.slice("words", F.greatest(F.col("place") - (size - 1), F.lit(0)) + 1, 2 * size - 1)
        met = (
            documents.select("doc_id", "text_key", "words", F.posexplode("words").alias("place", "anchor"))
            .select("doc_id", "text_key", "place", "anchor", around.alias("words"), F.size("words").alias("n"))
            .join(anchored, "anchor")
        )
        first = F.greatest(F.col("place") - (size - 1), F.lit(0))
        occurs = F.slice("words", begin - first + 1, F.size("window"))
    room = begin >= 0
    found = (
        met.filter(room)
        .filter(F.when(room, occurs == F.col("window")))
        .select("doc_id", "text_key", begin.alias("start"), (begin + F.size("window")).alias("stop"), "window")
    )
    items, few = small(windows)
    return found.join(F.broadcast(items) if few else items, "window").select("doc_id", "text_key", "start", "stop", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated.

    Hits are added up in two steps, first per start, so a document's group holds
    at most one row per word of that document.
    """
    hits = materialise(window_hits(docs, benchmark, size))
    key = ["doc_id", "text_key"]
    spans = hits.groupBy(*key, "start").agg(F.max("stop").alias("stop"))
    reach = F.max("stop").over(_ordered(key))
    covered = (
        spans.withColumn("before", F.coalesce(reach, F.lit(0)))
        .withColumn("fresh", F.greatest(F.col("stop") - F.greatest("start", "before"), F.lit(0)))
        .groupBy(*key)
        .agg(F.sum("fresh").cast("long").alias("n_hit"))
    )
    items = (
        hits.filter(F.col("item_id").isNotNull())
        .select(*key, "item_id")
        .distinct()
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    )
    per_document = materialise(covered.join(items, _same(covered, items, key), "left").select(
        covered["doc_id"].alias("hit_id"), covered["text_key"].alias("hit_key"), "n_hit", "items"
    ))
    counted = _documents(docs).select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(
        per_document, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left"
    ).select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"),
        F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (MIN_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, without contaminated texts."""
    hits = contamination(docs, benchmark, size).filter("contaminated").select(
        F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")
    )
    bad = materialise(hits.distinct())
    return docs.join(
        bad, docs["doc_id"].cast("bigint").eqNullSafe(bad["bad_id"]) & (text_key(docs["text"]) == bad["bad_key"]), "left_anti"
    )


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    out = F.lit(True)
    for name in key:
        out = out & a[name].eqNullSafe(b[name])
    return out


def _ordered(key: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
