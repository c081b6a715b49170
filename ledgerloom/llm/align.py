"""Cross-tokenizer alignment by diagonal run skipping.

A text is encoded twice, by a byte-level BPE (A, with a space put before the
text) and by a piece BPE (B, which adds that space itself). Where tokens of
both end at the same byte a group ends. Both lists of end bytes are walked at
an index shift, B's index less A's: stretches in which the two lists agree at
the current shift are found by comparing 1, 2, 4, ... entries at once and
jumped over; where they differ the shorter side is moved on until both end
alike, and the shift is taken anew.

Tokens of a group are linked to each other. The count of an id pair is the
number of documents that hold it linked, over the whole corpus. Documents are
worked on in blocks of about ``BLOCK_BYTES`` of text. A block is written once,
with its distinct linked pairs in order and, per pair, the documents that hold
it; pairs alone, one row per block, go through the shuffles that count them and
find each A id's highest count, and come back to their block. So neither a
common pair nor a long text makes a hot group: a pair has a row a block at most.

Definitions: a text that is null or empty, or whose A or B bytes differ from
the text with its space, has no tokens; its numbers are 0 and its digest is ''.
Strings of special tokens inside texts are plain text. Every row is a document,
rows that repeat too; ids may be null. Extra columns are ignored; an empty
table gives no rows. Ties for an A id's highest count all count as best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import bpe
from ledgerloom.llm import textvec as tv
from ledgerloom.llm.common import typed
from ledgerloom.llm.repair import library
from ledgerloom.session import materialise

BLOCK_BYTES = 16 << 20
BLOCK_DOCS = 60_000  # document numbers within a block take 16 bits
WIDE = 64  # links of a group beyond which its distinct ids are paired instead

_STATS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_DOCS = "array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>"
_BLOCK = f"block bigint, docs {_DOCS}, a array<int>, b array<int>, n array<int>, holders binary, times binary"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces(bpe.Vocabulary):
    """Ids of a sentencepiece BPE, asked once per distinct word.

    No piece has a space mark behind another letter, so the words that runs of
    spaces begin are encoded independently of each other.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
            if "▁" in piece.lstrip("▁"):
                raise ValueError("a piece spans a space: words cannot be encoded one by one")
        self._forget()

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        space = data == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1][offsets[:-1] < len(data)]] = True
        return np.flatnonzero(start)

    def fresh(self, words: list[bytes]) -> list[list[int]]:
        # The model puts the first space there itself. One space alone is no word of its own.
        ids = self.model.encode([w[1:].decode() for w in words], num_threads=1)
        return [i or [self.model.piece_to_id("▁")] for i in ids]


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def group_ends(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which A and which B tokens end a group; the last ends of both are alike."""
    n = len(ends_a)
    cut_a, cut_b = bytearray(n), bytearray(len(ends_b))
    ones = b"\1"
    i = shift = 0
    while i < n:
        # Jump the stretch that agrees at this shift, in doubling steps, then halving ones.
        step, grow = 1, True
        while step and i < n:
            j = i + shift
            here = ends_a[i : i + step]
            if here == ends_b[j : j + step]:
                size = len(here)
                cut_a[i : i + size] = cut_b[j : j + size] = ones * size
                i += size
                step = 2 * step if grow else step >> 1
            else:
                grow = False
                step >>= 1
        if i >= n:
            break
        # An irregular group: move the side that ends first until both end alike.
        j = i + shift
        x, y = ends_a[i], ends_b[j]
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        cut_a[i] = cut_b[j] = 1
        shift = j - i
        i += 1
    return np.frombuffer(bytes(cut_a), bool), np.frombuffer(bytes(cut_b), bool)


def _spelled(lengths: np.ndarray, heads: np.ndarray, pool: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The bytes of all ids, joined."""
    size = lengths[ids]
    before = np.cumsum(size) - size
    return pool[np.repeat(heads[ids] - before, size) + np.arange(int(size.sum()))]


class Side:
    """One tokenizer: ids of many texts, and the bytes of each id."""

    def __init__(self, vocabulary: bpe.Vocabulary):
        self.vocabulary = vocabulary
        self.size = len(vocabulary.bytes)
        self.lengths = np.fromiter(map(len, vocabulary.bytes), np.int64, self.size)
        self.heads = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first id per text, and which texts they spell exactly."""
        ids, first = self.vocabulary.encode_slice(data, offsets)
        ids = ids.astype(np.int64)
        spelled = _spelled(self.lengths, self.heads, self.pool, ids)
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])[first]
        same = np.diff(ends) == np.diff(offsets)
        if len(spelled) == len(data) and (ends == offsets).all():
            wrong = np.concatenate([[0], np.cumsum(spelled != data)])
            return ids, first, wrong[offsets[1:]] == wrong[offsets[:-1]]
        for row in np.flatnonzero(same).tolist():
            same[row] = np.array_equal(spelled[ends[row] : ends[row + 1]], data[offsets[row] : offsets[row + 1]])
        return ids, first, same


def _only(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of the texts marked in ``rows``."""
    counts = np.diff(first)
    return ids[np.repeat(rows, counts)], np.where(rows, counts, 0)


def _links(doc, a_ids, b_ids, a_of, b_of, n_groups) -> tuple[np.ndarray, ...]:
    """(doc, a, b, times) of all links; long groups pair their distinct ids."""
    size_a, size_b = np.bincount(a_of, minlength=n_groups), np.bincount(b_of, minlength=n_groups)
    first_b = np.cumsum(size_b) - size_b
    wide = size_a * size_b > WIDE
    keep = np.flatnonzero(~wide[a_of])
    width = size_b[a_of[keep]]
    left = np.repeat(keep, width)
    within = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width)
    parts = [(doc[a_of[left]], a_ids[left], b_ids[first_b[a_of[left]] + within], np.ones(len(left), np.int64))]
    first_a = np.cumsum(size_a) - size_a
    for g in np.flatnonzero(wide).tolist():
        a, times_a = np.unique(a_ids[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
        b, times_b = np.unique(b_ids[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
        n = len(a) * len(b)
        parts.append((np.full(n, doc[g]), np.repeat(a, len(b)), np.tile(b, len(a)), np.outer(times_a, times_b).ravel()))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Side(library(path_a)), Side(pieces(path_b))
        # Each id's decimal with what follows it: , within a side, | or ; behind it, nothing at the end.
        self.spoken = [f"{i}{mark}" for i in range(self.a.size) for mark in ",|"]
        self.spoken += [f"{i}{mark}" for i in range(self.b.size) for mark in (",", ";", "")]

    def slice(self, data: np.ndarray, offsets: np.ndarray):
        """Per text (n_a, n_b, n_groups, n_links, digest), and its links as (text, a, b, times) with distinct rows."""
        n = len(offsets) - 1
        a_ids, a_first, a_good = self.a.encode(data, offsets)
        b_ids, b_first, b_good = self.b.encode(data, offsets)
        good = a_good & b_good & (np.diff(offsets) > 1)
        (a_ids, n_a), (b_ids, n_b) = _only(a_ids, a_first, good), _only(b_ids, b_first, good)
        cut_a, cut_b = group_ends(np.cumsum(self.a.lengths[a_ids]).tolist(), np.cumsum(self.b.lengths[b_ids]).tolist())
        a_of = np.cumsum(cut_a) - cut_a
        b_of = np.cumsum(cut_b) - cut_b
        last_a = np.flatnonzero(cut_a)
        n_groups = len(last_a)
        doc = np.repeat(np.arange(n), n_a)[last_a]
        links = np.bincount(a_of, minlength=n_groups) * np.bincount(b_of, minlength=n_groups)
        per_doc = np.bincount(doc, minlength=n)
        before = np.concatenate([[0], np.cumsum(links)])[np.concatenate([[0], np.cumsum(per_doc)])]
        digests = self._digests(n, n_a, n_b, a_ids, b_ids, cut_a, cut_b, a_of, b_of)
        rows = list(zip(n_a.tolist(), n_b.tolist(), per_doc.tolist(), np.diff(before).tolist(), digests, strict=True))
        d, a, b, times = _links(doc, a_ids, b_ids, a_of, b_of, n_groups)
        key = (a * self.b.size + b) * n + d
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        times = np.add.reduceat(times, heads) if len(heads) else times
        key = key[heads]
        return rows, key // n, key % n, times

    def _digests(self, n, n_a, n_b, a_ids, b_ids, cut_a, cut_b, a_of, b_of) -> list[str]:
        first_b = np.flatnonzero(np.concatenate([np.ones(min(1, len(cut_b)), bool), cut_b[:-1]]))
        last_a = np.flatnonzero(cut_a) + 1
        code = np.empty(len(a_ids) + len(b_ids), np.int64)
        code[np.arange(len(a_ids)) + first_b[a_of]] = a_ids * 2 + cut_a
        end = np.zeros(len(b_ids), bool)
        ends = np.cumsum(n_b)
        end[ends[n_b > 0] - 1] = True
        code[np.arange(len(b_ids)) + last_a[b_of]] = 2 * self.a.size + b_ids * 3 + cut_b + end
        spoken = self.spoken
        words = [spoken[c] for c in code.tolist()]
        out, at = [], 0
        for size in (n_a + n_b).tolist():
            out.append(hashlib.sha256("".join(words[at : at + size]).encode()).hexdigest() if size else "")
            at += size
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def _spaced(texts: pa.Array) -> pa.Array:
    """A space before each text; null counts as empty."""
    return pa.array([" " + (t or "") for t in texts.to_pylist()], pa.large_string())


def _blocks(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(path_a, path_b)
        made = TaskContext.get().partitionId() << 32
        docs: list[tuple] = []
        pairs: list[np.ndarray] = []
        held: list[np.ndarray] = []
        times: list[np.ndarray] = []
        size = 0

        def given() -> pa.RecordBatch:
            pair, doc, many = (np.concatenate(x) for x in (pairs, held, times))
            order = np.argsort(pair * len(docs) + doc)
            pair, doc, many = pair[order], doc[order], many[order]
            heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1]]))
            n = np.diff(np.concatenate([heads, [len(pair)]]))
            struct = pa.array([dict(zip(_STATS, d, strict=True)) for d in docs], _docs_type())
            fields = [
                pa.array([made], pa.int64()), pa.ListArray.from_arrays([0, len(docs)], struct),
                *[pa.ListArray.from_arrays([0, len(heads)], pa.array(x.astype(np.int32))) for x in (pair[heads] // work.b.size, pair[heads] % work.b.size, n)],
                pa.array([doc.astype(np.uint16).tobytes()], pa.binary()), pa.array([many.astype(np.uint32).tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(fields, ["block", "docs", "a", "b", "n", "holders", "times"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            at = 0
            for _, data, offsets in tv.text_slices(_spaced(batch.column("text"))):
                rows, pair, doc, many = work.slice(data, offsets)
                pairs.append(pair)
                held.append(doc + len(docs))
                times.append(many)
                docs += [(i, *row) for i, row in zip(ids[at : at + len(rows)], rows, strict=True)]
                at += len(rows)
                size += len(data)
                if size >= BLOCK_BYTES or len(docs) >= BLOCK_DOCS:
                    yield given()
                    made += 1
                    docs, pairs, held, times, size = [], [], [], [], 0
        if docs:
            yield given()

    return run


def _docs_type() -> pa.DataType:
    longs = [(name, pa.int64()) for name in _STATS[:-1]]
    return pa.struct([*longs, (_STATS[-1], pa.string())])


def _answers(block: pa.Table, counted: pa.Table) -> pa.Table:
    """Per document of one block: its figures, the best links and the sum of counts."""
    docs = block.column("docs").combine_chunks().flatten().to_pylist()
    a, b, n = (block.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in "abn")
    holders = np.frombuffer(block.column("holders")[0].as_py(), np.uint16).astype(np.int64)
    times = np.frombuffer(block.column("times")[0].as_py(), np.uint32).astype(np.int64)
    got = {c: counted.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "count", "best")}
    order = np.lexsort((got["b"], got["a"]))
    if len(order) != len(a) or (got["a"][order] != a).any() or (got["b"][order] != b).any():
        raise RuntimeError("a block's pairs and their counts differ")
    best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    np.add.at(best, holders, times * np.repeat(got["best"][order], n))
    np.add.at(total, holders, times * np.repeat(got["count"][order], n))
    for d, x, y in zip(docs, best.tolist(), total.tolist(), strict=True):
        d["n_best"], d["count_sum"] = x, y
    return pa.Table.from_pylist(docs, pa.schema([*list(_docs_type())[:-1], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]))


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    path_a, path_b = path_a or bpe.default_vocabulary(), path_b or default_pieces()
    texts = typed(docs, doc_id="bigint", text="string")
    blocks = materialise(texts.mapInArrow(_blocks(path_a, path_b), _BLOCK))
    pairs = blocks.select("block", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("block", "p.a", "p.b", "p.n")
    counts = materialise(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")))
    # One row per id of A at most.
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    judged = counts.join(F.broadcast(highest), "a").select(
        "a", "b", "count", (F.col("count") == F.col("highest")).cast("long").alias("best")
    )
    back = pairs.select(F.col("block").alias("of_block"), "a", "b").join(judged, ["a", "b"])
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return blocks.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_answers, schema)
