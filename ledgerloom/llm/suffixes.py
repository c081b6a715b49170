"""Suffix-array deduplication: bytes covered by long strings that also start elsewhere.

A string start is sorted by induction from a sampled suffix to its right. The
samples are cut points that depend on the nearby bytes alone, so equal strings
have the same cut at the same distance. All starts that reach one cut first
form a suffix tuple, which stands for that many neighbouring suffixes:

1. Tuples are counted by their core, the bytes all their strings share; a core
   that occurs once ends there. If all tuples of a core are equal, every string
   of them repeats. Both follow from one grouped count, whatever its skew.
2. Cores with several different tuples are sorted. Groups beyond ``GROUP`` are
   split again and again into half the starts, which have longer cores, until
   each is small or a single string.
3. In a shard of such groups the sampled suffixes are ordered first, with the
   common prefix of neighbours. The order of the suffixes one byte to the left
   is induced from it: by that byte, then by the rank of the suffix to its
   right, the common prefix growing by one over the least value between the two
   ranks. Starts whose neighbours share ``LENGTH`` bytes are marked, and tuples
   that cannot reach that any more leave the queue.

The queues between the steps are tables and sorted shuffles, which Spark keeps
on disk; a task holds one run of ``SHARD`` tuples at a time.

Definitions: a text is its UTF-8 bytes, null is empty; strings never cross
texts. Rows that repeat are copies of each other, so their long strings repeat.
Equal tuples are
recognised by two 64-bit hashes, of the core and of all their bytes. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textvec as tv
from ledgerloom.llm.common import hinted, text_key, typed
from ledgerloom.session import materialise

LENGTH = 400
GRAM = 16  # bytes hashed at each place
REACH = 48  # a cut has the least hash this far to both sides
SPREAD = 280  # most starts in a tuple
GROUP = 4096  # tuples of one core sorted together
SHARD = 16_384  # tuples a task holds at once
KEYS_BYTES = 24 << 20  # of document keys sent to all tasks instead of shuffling texts

assert 2 * REACH + SPREAD + GRAM <= LENGTH

_TUPLE = pa.struct([(n, pa.int32() if n in ("cut", "u_min", "u_max") else pa.int64()) for n in ("cut", "u_min", "u_max", "core", "whole")])
_TUPLES = "array<struct<cut:int,u_min:int,u_max:int,core:bigint,whole:bigint>>"


def cut_points(data: np.ndarray, hashes: tv.SpanHashes) -> np.ndarray:
    """Places whose gram has the least hash within ``REACH``; ties are all cuts."""
    n = len(data)
    if n < GRAM:
        return np.zeros(0, np.int64)
    at = np.arange(n - GRAM + 1)
    back = tv.powers(n + 1, inverse=True)
    value = tv.mix((hashes.sums[GRAM:] - hashes.sums[: n - GRAM + 1]) * back[at]) >> np.uint64(32)
    value = np.minimum(value, 0xFFFFFFFE).astype(np.uint32)
    low = np.full(n + 2 * REACH, 0xFFFFFFFF, np.uint32)
    low[REACH : REACH + len(value)] = value
    width = 1
    while 2 * width <= 2 * REACH + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = 2 * REACH + 1 - width
    least = np.minimum(low[: len(value)], low[rest : rest + len(value)])
    return np.flatnonzero(value == least)


def tuples_of_slice(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(tuples per text, columns) of the texts of one slice; cut is relative to its text.

    u counts the starts to the left of ``cut - REACH``; a single string outside
    any tuple has u_min = u_max = -1 and its start in ``cut``.
    """
    hashes = tv.SpanHashes(data)
    cuts = cut_points(data, hashes)
    row = np.searchsorted(offsets, cuts, "right") - 1
    begin, end = offsets[row], offsets[row + 1]
    previous = np.concatenate([[-(1 << 40)], cuts[:-1]]) if len(cuts) else cuts
    base = cuts - REACH
    first = np.maximum(np.maximum(previous - REACH + 1, base - SPREAD + 1), begin)
    last = np.minimum(base, end - LENGTH)
    ok = last >= first
    row, base, first, last, cuts, begin = (x[ok] for x in (row, base, first, last, cuts, begin))
    # Starts that no tuple holds: the next cut is too far away.
    held = np.zeros(len(data) + 1, np.int32)
    np.add.at(held, first, 1)
    np.add.at(held, last + 1, -1)
    n_starts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    is_start = np.zeros(len(data) + 1, np.int32)
    np.add.at(is_start, offsets[:-1], (n_starts > 0).astype(np.int32))
    np.add.at(is_start, offsets[:-1] + n_starts, -(n_starts > 0).astype(np.int32))
    lone = np.flatnonzero((np.cumsum(is_start) > 0) & (np.cumsum(held) == 0))
    lone = lone[lone < len(data)]
    lone_row = np.searchsorted(offsets, lone, "right") - 1

    start = np.concatenate([first, lone])
    stop = np.concatenate([last, lone]) + LENGTH
    rows = np.concatenate([row, lone_row])
    u_min = np.concatenate([base - last, np.full(len(lone), -1)])
    u_max = np.concatenate([base - first, np.full(len(lone), -1)])
    shape = tv.mix((u_min + 1).astype(np.uint64) * np.uint64(1 << 32) + (u_max + 1).astype(np.uint64))
    whole = hashes.of(start, stop) ^ shape
    core_stop = np.concatenate([base + LENGTH - SPREAD + 1, stop[len(first):]])
    core = hashes.of(np.concatenate([base, lone]), core_stop)
    order = np.lexsort((start, rows))
    columns = {
        "cut": np.concatenate([cuts, lone]) - offsets[rows],
        "u_min": u_min, "u_max": u_max, "core": core.view(np.int64), "whole": whole.view(np.int64),
    }
    return np.bincount(rows, minlength=len(offsets) - 1), {k: v[order] for k, v in columns.items()}


def suffix_tuples(texts: pa.Array) -> pa.Array:
    counts, parts = [np.zeros(0, np.int64)], []
    for _, data, offsets in tv.text_slices(texts):
        n, columns = tuples_of_slice(data, offsets)
        counts.append(n)
        parts.append(columns)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    fields = list(_TUPLE)
    arrays = [
        pa.array(np.concatenate([p[f.name] for p in parts]) if parts else np.zeros(0), f.type, safe=False) for f in fields
    ]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, fields=fields))


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low + 1 .. high]) for each pair low < high."""
    out = np.empty(len(low), values.dtype)
    level = values
    span = high - low
    power = np.frexp(span)[1] - 1
    for k in range(int(power.max()) + 1 if len(power) else 0):
        here = power == k
        out[here] = np.minimum(level[low[here] + 1], level[high[here] - (1 << k) + 1])
        level = np.minimum(level[: -(1 << k)], level[1 << k :]) if len(level) > 1 << k else level
    return out


def induce(block: list[bytes], u_min: np.ndarray, u_max: np.ndarray, u0: int, u1: int) -> list[tuple[int, int, int]]:
    """(tuple, u from, u to) of the marked starts of one shard; to is exclusive.

    Row i of ``place`` holds tuple i's bytes so that the string at u starts in
    column ``width - u``; bytes beyond a text's end are 0 and never decide,
    because a start counts only where its own string is whole.
    """
    n, width = len(block), int(u1 - 1)
    place = np.zeros((n, width + LENGTH - u0), np.uint8)
    for i, b in enumerate(block):
        raw = np.frombuffer(b, np.uint8)
        left = width - int(u_max[i])
        skip = max(0, -left)
        piece = raw[skip : skip + place.shape[1] - max(left, 0)]
        place[i, max(left, 0) : max(left, 0) + len(piece)] = piece
    # The sampled suffixes: ordered by their words, compared with their neighbours.
    head = np.ascontiguousarray(place[:, width - u0 :])
    words = head.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    gaps = head[order[1:]] != head[order[:-1]]
    common = np.zeros(n, np.int64)
    common[1:] = np.where(gaps.any(axis=1), gaps.argmax(axis=1), LENGTH)
    marks: list[tuple[np.ndarray, int]] = []
    for u in range(u0, u1):
        if u > u0:
            stay = u_max[order] >= u
            best = common.copy()
            best[:-1] = np.maximum(best[:-1], common[1:])
            stay &= best + (u1 - u) >= LENGTH
            kept = np.flatnonzero(stay)
            if len(kept) < 2:
                break
            common = np.concatenate([[0], _least_between(common, kept[:-1], kept[1:])])
            order = order[kept]
            symbol = place[order, width - u]
            sorted_at = np.argsort(symbol, kind="stable")
            low, high = sorted_at[:-1], sorted_at[1:]
            alike = symbol[low] == symbol[high]
            grown = np.zeros(len(order), np.int64)
            grown[1:][alike] = 1 + _least_between(common, low[alike], high[alike])
            order, common = order[sorted_at], grown
        run = np.cumsum(common < LENGTH)
        whole = (u_min[order] <= u) & (u <= u_max[order])
        twice = np.bincount(run[whole], minlength=run[-1] + 1) >= 2
        marks.append((order[whole & twice[run]], u))
    if not marks:
        return []
    who = np.concatenate([m for m, _ in marks])
    where = np.concatenate([np.full(len(m), u) for m, u in marks])
    by = np.lexsort((where, who))
    who, where = who[by], where[by]
    if not len(who):
        return []
    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (where[1:] != where[:-1] + 1)]))
    final = np.concatenate([first[1:], [len(who)]]) - 1
    return list(zip(who[first].tolist(), where[first].tolist(), (where[final] + 1).tolist(), strict=True))


_MARKS = "core bigint, whole bigint, u_from int, u_to int"


def _sort_shards(batches):
    """Marks of a partition that is sorted by (u0, u1, part): one run of whole groups at a time."""
    held: list[dict] = []

    def flush(rows: list[dict]):
        if not rows:
            return
        found = induce(
            [r["block"] for r in rows], np.array([r["u_min"] for r in rows]), np.array([r["u_max"] for r in rows]),
            rows[0]["u0"], rows[0]["u1"],
        )
        if found:
            yield pa.RecordBatch.from_pylist(
                [{**{k: rows[i][k] for k in ("core", "whole")}, "u_from": a, "u_to": b} for i, a, b in found],
                pa.schema([("core", pa.int64()), ("whole", pa.int64()), ("u_from", pa.int32()), ("u_to", pa.int32())]),
            )

    for batch in batches:
        for r in batch.to_pylist():
            if held and (r["u0"], r["u1"]) != (held[0]["u0"], held[0]["u1"]) or (
                len(held) >= SHARD and r["part"] != held[-1]["part"]
            ):
                yield from flush(held)
                held = []
            held.append(r)
    yield from flush(held)


def _blocks(texts: pa.Array, wanted: pa.Array) -> pa.Array:
    """The bytes of each wanted tuple of each text."""
    out = []
    for t, rows in zip(texts, wanted.to_pylist(), strict=True):
        raw = (t.as_py() or "").encode()
        out.append([
            {**r, "block": raw[r["cut"] - REACH - r["u_max"] : r["cut"] - REACH - r["u_min"] + LENGTH]} for r in rows or []
        ])
    kind = pa.list_(pa.struct([*_TUPLE, pa.field("block", pa.binary())]))
    return pa.array(out, kind)


def _parts(tuples: DataFrame) -> DataFrame:
    """Tuples with their strings' shared bytes as ``part`` for the starts u0 <= u < u1."""
    from_ = F.col("u_max") - F.col("u0")
    shared = F.substring("block", from_ + 1, LENGTH + 1 - (F.col("u1") - F.col("u0")))
    return tuples.withColumn("part", F.xxhash64(shared))


def _sorted_marks(tuples: DataFrame) -> DataFrame:
    """Marks of tuples (core, whole, u_min, u_max, block) whose cores repeat unequally."""
    key = ["u0", "u1", "part"]
    marks = None
    todo = _parts(tuples.withColumns({"u0": F.lit(0), "u1": F.lit(SPREAD)}))
    while True:
        todo = materialise(todo)
        groups = materialise(todo.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"))
        live = todo.join(groups, key)
        shards = live.filter((F.col("n") <= GROUP) & (F.col("u1") - F.col("u0") > 1)).drop("n")
        sorted_ = shards.repartition(*key).sortWithinPartitions("u0", "u1", "part").mapInArrow(_sort_shards, _MARKS)
        # A part of one start is a whole string, and it occurs more than once.
        single = live.filter(F.col("u1") - F.col("u0") == 1).select("core", "whole", F.col("u0").alias("u_from"), F.col("u1").alias("u_to"))
        step = sorted_.union(single)
        marks = step if marks is None else marks.union(step)
        large = live.filter((F.col("n") > GROUP) & (F.col("u1") - F.col("u0") > 1)).drop("n", "part")
        middle = F.floor((F.col("u0") + F.col("u1")) / 2).cast("int")
        halves = F.explode(F.array(
            F.struct(F.col("u0").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("u1").alias("b"))
        ))
        large = large.withColumn("h", halves).withColumns({"u0": F.col("h.a"), "u1": F.col("h.b")}).drop("h")
        # A half that holds no start of the tuple, or whose shared bytes end beyond the text, is none.
        large = materialise(large.filter((F.col("u_max") >= F.col("u0")) & (F.col("u_min") < F.col("u1"))))
        if large.isEmpty():
            return marks
        todo = _parts(large)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, ranges: byte ranges covered by strings that also start elsewhere.

    One row per distinct (doc_id, text) with such a string; ranges may overlap.
    """
    plain = typed(docs, doc_id="bigint", text="string").withColumn("text_key", text_key(F.col("text")))
    tuples = plain.select("doc_id", "text_key", F.explode(F.arrow_udf(suffix_tuples, _TUPLES)("text")).alias("t"))
    tuples = materialise(tuples.select("doc_id", "text_key", "t.*"))
    cores = tuples.groupBy("core").agg(
        F.count("*").alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b")
    )
    cores = cores.filter("n > 1").select("core", (F.col("a") == F.col("b")).alias("equal"))
    live = materialise(tuples.join(materialise(cores), "core"))
    name = ["core", "whole"]
    mixed = live.filter("not equal")
    distinct = materialise(mixed.groupBy(*name).agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "cut", "u_min", "u_max")).alias("r")
    ))
    again = distinct.filter("n > 1")
    whole_range = [F.col("r.u_min").alias("u_from"), (F.col("r.u_max") + 1).alias("u_to")]

    def covered(rows: DataFrame, u_from: Column, u_to: Column) -> DataFrame:
        """Byte ranges of the starts u_from <= u < u_to of tuples."""
        single = F.col("u_max") < 0
        start = F.when(single, F.col("cut")).otherwise(F.col("cut") - REACH - u_to + 1)
        stop = F.when(single, F.col("cut")).otherwise(F.col("cut") - REACH - u_from) + LENGTH
        return rows.select("doc_id", "text_key", start.alias("start"), stop.alias("stop"))

    ranges = covered(live.filter("equal"), F.col("u_min"), F.col("u_max") + 1)

    # One copy of each different tuple is fetched from its text and sorted.
    fetch = distinct.filter("r.u_max >= 0").groupBy(F.col("r.doc_id").alias("w_id"), F.col("r.text_key").alias("w_key")).agg(
        F.collect_list(F.struct("r.cut", "r.u_min", "r.u_max", *name)).alias("wanted")
    )
    fetch = materialise(fetch)
    same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key"))
    with_text = _only(plain, fetch.select("w_id", "w_key"), "left_semi")
    with_text = with_text.dropDuplicates(["doc_id", "text_key"]) if _repeats(tuples) else with_text
    kind = _TUPLES.replace("whole:bigint", "whole:bigint,block:binary")
    blocks = with_text.join(fetch, same).select(F.explode(F.arrow_udf(_blocks, kind)("text", "wanted")).alias("b")).select("b.*")
    # A text that stands in several rows was fetched once for each.
    marks = materialise(_sorted_marks(blocks.drop("cut")))
    # One table of hits, joined once: Spark can split a tuple that stands in very many texts.
    hits = materialise(
        marks.join(again.select(*name), name, "left_anti").distinct().unionByName(again.select(*name, *whole_range))
    )
    found = covered(mixed.join(hits, name), F.col("u_from"), F.col("u_to"))
    every = ranges.unionByName(found)
    return every.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))


def _only(plain: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of (doc_id, text_key) that are among the keys or not; texts are shuffled only for keys beyond a broadcast."""
    keys = hinted(keys.toDF("k_id", "k_key"), KEYS_BYTES)
    return plain.join(keys, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_key") == F.col("k_key")), how)


def _repeats(tuples: DataFrame) -> bool:
    """Whether some (doc_id, text) stands in several rows: then a cut occurs twice."""
    key = ["doc_id", "text_key"]
    heads = tuples.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct("cut", "u_min").alias("d"))
    return not heads.filter("n > d").isEmpty()


_OUT = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"


def _remove(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    out = []
    for t, rows in zip(texts, ranges.to_pylist(), strict=True):
        raw = (t.as_py() or "").encode()
        spans: list[list[int]] = []
        for a, b in sorted((r["start"], r["stop"]) for r in rows or []):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        parts, at = [], 0
        for a, b in spans:
            parts.append(raw[at:a])
            at = b
        kept = b"".join([*parts, raw[at:]])
        out.append({"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(spans), "kept": kept})
    return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row."""
    plain = typed(docs, doc_id="bigint", text="string").withColumn("text_key", text_key(F.col("text")))
    ranges = materialise(repeated_ranges(docs).select(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"), "ranges"))
    keys = ranges.select("r_id", "r_key")
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key"))
    hit = _only(plain, keys, "left_semi").join(ranges, same).select("doc_id", "text", "ranges")
    clean = _only(plain, keys, "left_anti").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("kept"))
    zero = F.lit(0).cast("bigint")
    untouched = clean.select("doc_id", F.octet_length("kept").cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), "kept")
    return hit.select("doc_id", F.arrow_udf(_remove, _OUT)("text", "ranges").alias("r")).select("doc_id", "r.*").unionByName(untouched)
