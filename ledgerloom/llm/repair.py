"""Token-id output with Re-Pair grammar compression and random-access decoding.

Documents are encoded, ordered by id and cut into blocks. In each block frequent
neighbouring pairs of symbols are replaced by nonterminals, round after round,
until no pair occurs ``LEAST`` times.
One round replaces many pairs at once: no symbol of the chosen pairs stands left
in one and right in another, so their occurrences never overlap and the result
is that of replacing them one after the other. A pair never spans documents.

File format: a Parquet table, one row per block: ``part`` and ``block`` number
it in document order, ``first`` counts the ids before it in its part, ``n_ids``
its own, ``doc_ids`` its documents, and ``payload`` is binary, little-endian::

    4 bytes  "RPG1"
    uint32   terminals, rounds, rules, documents, symbols, bytes per symbol (2 or 4)
    uint32   first rule of each round
    uint32   left and right symbol of each rule
    uint32   expansion length of each rule
    uint32   symbols of each document, then ids of each document
    uint16 or uint32  symbols

A document is decoded alone: its symbols are found by adding up the counts, and
the expansion lengths give any id's place without expanding what lies before.

Definitions: null texts are empty; every document ends with the end id, so an
empty one has one id. Documents are ordered by (doc_id, text hash), null ids
first. Rows that repeat are documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe
from ledgerloom.llm.common import text_key, typed

END_ID = 2
BLOCK_IDS = 1 << 19  # a block ends with the document that reaches this many ids
PAIRS = 1_000  # most pairs replaced in one round; there are as many rounds as it takes
LEAST = 24  # least occurrences of a pair worth a rule
_BUCKETS = 17


class LibraryVocabulary(bpe.Vocabulary):
    """Ids from the tokenizers library itself, asked once per distinct pre-token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        self.library = Tokenizer.from_file(path)
        self.letters = [""] * 256
        for letter, b in bpe.byte_letters().items():
            self.letters[b] = letter
        super().__init__(path)

    def fresh(self, words: list[bytes]) -> list[list[int]]:
        tokenize, letters = self.library.model.tokenize, self.letters
        return [[t.id for t in tokenize("".join([letters[b] for b in w]))] for w in words]


_libraries: dict[str, LibraryVocabulary] = {}


def library(path: str) -> LibraryVocabulary:
    if path not in _libraries:
        _libraries[path] = LibraryVocabulary(path)
    return _libraries[path]


def _frequent_pairs(left: np.ndarray, right: np.ndarray, open_: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """The most frequent pairs whose left and right symbols do not mix, and where they stand.

    Pairs are counted by bucket first; only those of the fullest buckets are
    told apart and counted exactly. None are returned only if no pair occurs
    ``LEAST`` times: where the fullest buckets hold many rare pairs, all
    buckets that could hold a frequent one are looked at.
    """
    bucket = (((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(32 - _BUCKETS)) + np.uint32(1)
    bucket *= open_  # pairs across documents are in bucket 0
    counts = np.bincount(bucket, minlength=(1 << _BUCKETS) + 1)
    counts[0] = 0
    bar = max(LEAST, int(np.partition(counts, -PAIRS)[-PAIRS]))
    found = _of_buckets(left, right, bucket, counts >= bar)
    return found if found[0] or bar == LEAST else _of_buckets(left, right, bucket, counts >= LEAST)


def _of_buckets(
    left: np.ndarray, right: np.ndarray, bucket: np.ndarray, looked_at: np.ndarray
) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    here = np.flatnonzero(looked_at[bucket])
    a_here, b_here, bucket = left[here], right[here], bucket[here]
    keys = np.sort(a_here.astype(np.uint64) << np.uint64(32) | b_here)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    n = np.diff(np.concatenate([first, [len(keys)]]))
    pairs, n = keys[first][n >= LEAST], n[n >= LEAST]
    lefts: set[int] = set()
    rights: set[int] = set()
    alone: set[int] = set()
    chosen: list[tuple[int, int]] = []
    rule_of = np.full((1 << _BUCKETS) + 1, -1, np.int32)
    for i in np.argsort(-n, kind="stable").tolist():
        if len(chosen) == PAIRS:
            break
        a, b = int(pairs[i]) >> 32, int(pairs[i]) & 0xFFFFFFFF
        if a in alone or b in alone or a in rights or b in lefts:
            continue
        place = ((((a * 0x9E3779B1) ^ (b * 0x85EBCA77)) & 0xFFFFFFFF) >> (32 - _BUCKETS)) + 1
        if rule_of[place] >= 0:
            continue  # another pair of this round has its bucket: a later round's turn
        if a != b:
            lefts.add(a)
            rights.add(b)
        elif a in lefts or a in rights:
            continue
        else:
            alone.add(a)
        rule_of[place] = len(chosen)
        chosen.append((a, b))
    if not chosen:
        return chosen, here[:0], here[:0]
    rules = rule_of[bucket]
    of = np.array(chosen, np.uint32)
    hit = (rules >= 0) & (a_here == of[rules, 0]) & (b_here == of[rules, 1])
    return chosen, here[hit], rules[hit]


def compress(ids: list[np.ndarray], terminals: int) -> bytes:
    """The payload of a block of documents."""
    sizes = np.array([len(i) for i in ids], np.int64)
    symbols = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    ends = np.cumsum(sizes)
    last[ends[sizes > 0] - 1] = True
    rules: list[tuple[int, int]] = []
    first_rules = []
    lengths = np.ones(terminals, np.uint32)
    while len(symbols) >= 2:
        left, right, open_ = symbols[:-1], symbols[1:], ~last[:-1]
        chosen, at, rule = _frequent_pairs(left, right, open_)
        if not chosen:
            break
        base = terminals + len(rules)
        first_rules.append(len(rules))
        # Of overlapping pairs of one symbol with itself, every other one counts.
        follows = np.concatenate([[False], (at[1:] == at[:-1] + 1)])
        start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
        keep = (np.arange(len(at)) - start) % 2 == 0
        at, rule = at[keep], rule[keep]
        symbols = symbols.copy()
        symbols[at] = base + rule
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        last[at] |= last[at + 1]
        symbols, last = symbols[stay], last[stay]
        rules += chosen
        lengths = np.concatenate([lengths, lengths[[a for a, _ in chosen]] + lengths[[b for _, b in chosen]]])
    n_symbols = np.zeros(len(sizes), np.int64)
    stops = np.flatnonzero(last) + 1
    n_symbols[sizes > 0] = np.diff(np.concatenate([[0], stops]))
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    header = np.array([terminals, len(first_rules), len(rules), len(sizes), len(symbols), width], "<u4")
    flat = np.array(rules, "<u4").reshape(-1)
    parts = [header, np.array(first_rules, "<u4"), flat, lengths[terminals:].astype("<u4"), n_symbols.astype("<u4"), sizes.astype("<u4")]
    return b"RPG1" + b"".join(p.tobytes() for p in parts) + symbols.astype(f"<u{width}").tobytes()


class Block:
    """A payload opened for decoding."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RPG1":
            raise ValueError("not a block of token ids")
        head = np.frombuffer(payload, "<u4", 6, 4)
        self.terminals, rounds, n_rules, n_docs, n_symbols, width = head.tolist()
        at = 28

        def take(n: int, kind: str = "<u4") -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.first_rules = take(rounds)
        self.rules = take(2 * n_rules).reshape(-1, 2)
        self.lengths = take(n_rules)
        self.symbol_ends = np.concatenate([[0], np.cumsum(take(n_docs), dtype=np.int64)])
        self.sizes = take(n_docs)
        self.symbols = take(n_symbols, f"<u{width}")
        self.pool: np.ndarray | None = None

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if self.pool is None:
            # Rules only name symbols that stand before them.
            known: list[np.ndarray] = []
            part = lambda s: self.single[s : s + 1] if s < self.terminals else known[s - self.terminals]
            self.single = np.arange(self.terminals, dtype=np.uint32)
            for a, b in self.rules.tolist():
                known.append(np.concatenate([part(a), part(b)]))
            self.pool = np.concatenate([self.single, *known])
            self.every = np.concatenate([np.ones(self.terminals, np.int64), self.lengths])
            self.at = np.cumsum(self.every) - self.every
        size = self.every[symbols]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.at[symbols] - (ends - size), size) + np.arange(total)]

    def all_ids(self) -> np.ndarray:
        return self.expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        """The ids of one document."""
        return self.expand(self.symbols[self.symbol_ends[i] : self.symbol_ends[i + 1]])

    def id_at(self, i: int, place: int) -> int:
        """One id of one document, by expansion lengths alone."""
        symbols = self.symbols[self.symbol_ends[i] : self.symbol_ends[i + 1]].astype(np.int64)
        every = np.concatenate([np.ones(self.terminals, np.uint32), self.lengths])
        ends = np.cumsum(every[symbols], dtype=np.int64)
        k = int(np.searchsorted(ends, place, "right"))
        symbol, place = int(symbols[k]), place - int(ends[k - 1] if k else 0)
        while symbol >= self.terminals:
            a, b = self.rules[symbol - self.terminals].tolist()
            symbol, place = (a, place) if place < every[a] else (b, place - int(every[a]))
        return symbol


_ROWS = "part int, block int, first bigint, n_ids bigint, doc_ids array<bigint>, payload binary"
_ROW_TYPE = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary()),
])


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of all documents, in order of doc_id, as blocks below ``path``."""
    vocabulary = vocabulary or bpe.default_vocabulary()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = library(vocabulary)
        end = np.array([end_id], np.uint32)
        terminals = max(len(v.bytes), end_id + 1)
        part, first, number, held, names, n = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"part": part, "block": number, "first": first, "n_ids": n, "doc_ids": names, "payload": compress(held, terminals)}],
                _ROW_TYPE,
            )

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), v.encode_all(batch["text"]), strict=True):
                held += [np.concatenate([ids, end])]
                names.append(doc_id)
                n += len(ids) + 1
                if n >= BLOCK_IDS:
                    yield row()
                    first, number, held, names, n = first + n, number + 1, [], [], 0
        if names:
            yield row()

    plain = typed(docs, doc_id="bigint", text="string").withColumn("_key", text_key(F.col("text")))
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = plain.repartitionByRange(n_parts, "doc_id", "_key").sortWithinPartitions("doc_id", "_key").select("doc_id", "text")
    ordered.mapInArrow(blocks, _ROWS).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The block rows, with ``start``: the ids of all documents before the block."""
    rows = spark.read.parquet(path)
    # One row per part: as many as the writer had tasks.
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    every = F.array_sort(F.collect_list(F.struct("part", "n")))
    before = totals.agg(every.alias("all")).select(F.explode(F.transform("all", lambda p, i: F.struct(
        p["part"].alias("part"),
        F.aggregate(F.slice("all", 1, i), F.lit(0).cast("long"), lambda s, q: s + q["n"]).alias("before"),
    ))).alias("b")).select("b.*")
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("first") + F.col("before"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r["payload"])
                ids = block.all_ids().astype("<u4")
                ends = np.cumsum(block.sizes, dtype=np.int64)
                starts = ends - block.sizes
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + starts), pa.array(block.sizes.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = read_blocks(spark, path).select("start", "doc_ids", "payload")
    return rows.mapInArrow(decoded, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids of every document."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r["payload"])
                ids = [block.document(i) for i in range(len(block.sizes))]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return spark.read.parquet(path).select("doc_ids", "payload").mapInArrow(decoded, "doc_id bigint, ids array<bigint>")
