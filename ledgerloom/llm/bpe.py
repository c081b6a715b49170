"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut into pre-tokens, and each pre-token's bytes start as one symbol
each. The leaves of a segment tree hold the merge rank of every symbol and its
right neighbour; the root therefore names the leftmost merge of the lowest
rank. A merge changes three leaves at most, each updated up to the root, so a
pre-token of n bytes takes O(n log n) steps however long it is. Pre-tokens are
found for many texts at once, and distinct ones are encoded once per slice of
texts, or once per worker while a bounded cache holds them.

Ids equal those of the tokenizers library with added special tokens off. A
special token's string inside a text is its own id, as in the library. Null
texts are empty; empty texts have no ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textvec as tv
from ledgerloom.llm.common import typed

CACHED = 1_000_000  # distinct pre-tokens a worker remembers, by 64-bit hash
TOLD = 10_000  # new pre-tokens whose ids are Python lists at a time
ENCODED_BYTES = 1 << 18  # bytes of texts encoded together
_NONE = 1 << 80


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, by rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in plain]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


_LETTER, _NUMBER, _OTHER, _SPACE, _BORDER = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, as the pre-token pattern sees it."""
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    # White space as Unicode has it: without the separators 0x1C to 0x1F.
    space = regex.compile(r"[\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]")
    for first in range(0, 0x110000, 0x800):
        if first == 0xD800:
            continue  # surrogates
        some = np.arange(first, first + 0x800, dtype="<u4").tobytes().decode("utf-32-le")
        for pattern, kind in ((regex.compile(r"\p{L}+"), _LETTER), (regex.compile(r"\p{N}+"), _NUMBER), (space, _SPACE)):
            table[np.frombuffer("".join(pattern.findall(some)).encode("utf-32-le"), "<u4")] = kind
    return table


def pre_token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of all pre-tokens of the texts of one slice.

    The pattern is: a contraction ('s 't 're 've 'm 'll 'd); letters, digits or
    other signs with one space before them; white space up to the last one
    before a word; white space.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    kind = _classes()[points]
    n = len(kind)
    border = np.zeros(n + 1, bool)
    border[np.searchsorted(heads, offsets)] = True
    before = np.full(n, _BORDER, np.uint8)
    before[1:] = np.where(border[1:n], _BORDER, kind[:-1])
    after = np.full(n, _BORDER, np.uint8)
    after[:-1] = np.where(border[1:n], _BORDER, kind[1:])
    space = kind == _SPACE
    # A word starts at its space, if that is a plain one.
    led = np.zeros(n, bool)
    led[1:] = (before[1:] == _SPACE) & (points[:-1] == 0x20)
    start = before == _BORDER
    start |= ~space & (before != kind) & ~led
    start |= space & ((before != _SPACE) | (after < _SPACE))
    # Contractions: the sign keeps its letters, the letters behind them start anew.
    sign = np.flatnonzero(start & (points == 0x27) & (after == _LETTER))
    if len(sign):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = padded[sign + 1], padded[sign + 2]
        near = ~border[np.minimum(sign + 2, n)]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = near & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
        for found, size in ((sign[single], 2), (sign[double], 3)):
            start[found + 1] = False
            behind = found + size
            behind = behind[behind < n]
            start[behind[kind[behind] != _SPACE]] = True
    return heads[start]


class Vocabulary:
    """Merges, ids and bytes of one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.splitter = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        # (left, right) -> rank and merged id in one integer, ordered by rank.
        self.merges: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[left], vocab[right]] = rank << 20 | vocab[left + right]
        self._forget()

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges.get
        size = 1 << max(0, (n - 2).bit_length())
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            rank = merges((ids[i], ids[i + 1]))
            if rank is not None:
                tree[size + i] = rank << 40 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while tree[1] != _NONE:
            root = tree[1]
            at = root & 0xFFFFFFFFFF
            gone = after[at]
            ids[at] = root >> 40 & 0xFFFFF
            ids[gone] = -1
            right = after[at] = after[gone]
            left = before[at]
            changes = []
            if right < n:
                before[right] = at
                rank = merges((ids[at], ids[right]))
                changes.append((at, _NONE if rank is None else rank << 40 | at))
                changes.append((gone, _NONE))
            else:
                changes.append((at, _NONE))
                if gone < n - 1:
                    changes.append((gone, _NONE))
            if left >= 0:
                rank = merges((ids[left], ids[at]))
                changes.append((left, _NONE if rank is None else rank << 40 | left))
            for leaf, value in changes:
                i = size + leaf
                if tree[i] == value:
                    continue
                tree[i] = value
                i >>= 1
                while i:
                    a, b = tree[2 * i], tree[2 * i + 1]
                    least = a if a < b else b
                    if tree[i] == least:
                        break
                    tree[i] = least
                    i >>= 1
        return [i for i in ids if i >= 0]

    def fresh(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens that are not in the cache."""
        return [self.merge(w) for w in words]

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of the parts that are encoded on their own."""
        return pre_token_starts(data, offsets)

    def _forget(self) -> None:
        """Empty the cache: sorted hashes of pre-tokens, and where their ids are in one pool."""
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def known(self, hashes: np.ndarray, word) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids in the pool for sorted distinct hashes; ``word(i)`` is a pre-token's bytes."""
        place = np.searchsorted(self.keys, hashes)
        there = np.zeros(len(hashes), bool)
        inside = place < len(self.keys)
        there[inside] = self.keys[place[inside]] == hashes[inside]
        lost = np.flatnonzero(~there)
        if len(self.keys) + len(lost) > CACHED and len(self.keys):
            self._forget()
            return self.known(hashes, word)
        if len(lost):
            pools, sizes = [self.pool], []
            for first in range(0, len(lost), TOLD):
                ids = self.fresh([word(i) for i in lost[first : first + TOLD].tolist()])
                sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                pools.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))
            size = np.concatenate(sizes)
            at = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate(pools)
            into = place[lost]
            self.keys = np.insert(self.keys, into, hashes[lost])
            self.at = np.insert(self.at, into, at)
            self.size = np.insert(self.size, into, size)
            place = np.searchsorted(self.keys, hashes)
        return self.at[place], self.size[place]

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and the first id's number per text."""
        starts = self.starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.concatenate([starts[1:], [len(data)]])
        hashes = tv.PrimeHashes(data).of(starts, ends)
        distinct, head, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        first, last = starts[head], ends[head]
        at, sizes = self.known(distinct, lambda i: raw[first[i] : last[i]])
        each = sizes[which]
        before = np.concatenate([[0], np.cumsum(each)])
        out = self.pool[np.repeat(at[which] - before[:-1], each) + np.arange(before[-1])]
        return out, before[np.searchsorted(starts, offsets)]

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column."""
        out: list[np.ndarray] = []
        for _, data, offsets in tv.text_slices(texts, ENCODED_BYTES):
            raw = data.tobytes()
            if any(s.encode() in raw for s in self.special):
                out += [self.encode_one(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            else:
                ids, first = self.encode_slice(data, offsets)
                out += np.split(ids, first[1:-1])
        return out

    def encode_one(self, raw: bytes) -> np.ndarray:
        """Ids of one text that may hold special tokens."""
        parts = [np.zeros(0, np.uint32)]
        for piece in self.splitter.split(raw.decode()) if self.splitter else (raw.decode(),):
            if piece in self.special:
                parts.append(np.array([self.special[piece]], np.uint32))
            elif piece:
                data = np.frombuffer(piece.encode(), np.uint8)
                parts.append(self.encode_slice(data, np.array([0, len(data)]))[0])
        return np.concatenate(parts).astype(np.uint32)

    def decode(self, ids: bytes) -> str:
        """Text of little-endian uint32 ids; bytes that are no UTF-8 are replaced."""
        of = self.bytes
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_ROUND_TRIP = "struct<ids:binary,decoded:string>"


def round_trip(text: Column, path: str | None = None) -> Column:
    """ids (little-endian uint32) of a text, and the text decoded from them."""
    path = path or default_vocabulary()

    def run(texts: pa.Array) -> pa.Array:
        v = vocabulary(path)
        ids = [i.tobytes() for i in v.encode_all(texts)]
        return pa.StructArray.from_arrays(
            [pa.array(ids, pa.binary()), pa.array([v.decode(i) for i in ids], pa.string())], ["ids", "decoded"]
        )

    return F.arrow_udf(run, _ROUND_TRIP)(text.cast("string"))


def encode(text: Column, path: str | None = None) -> Column:
    """Ids of a text as little-endian uint32 in a binary."""
    path = path or default_vocabulary()

    def run(texts: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([i.tobytes() for i in v.encode_all(texts)], pa.binary())

    return F.arrow_udf(run, "binary")(text.cast("string"))


def decode(ids: Column, path: str | None = None) -> Column:
    """Text of an ids binary; null stays null."""
    path = path or default_vocabulary()

    def run(values: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([None if i is None else v.decode(i) for i in values.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(ids)


def _digests(path: str, with_ids: bool):
    """Count and digests of each text's ids and of the text decoded from them; the decoded text itself stays here."""

    def run(texts: pa.Array) -> pa.Array:
        v = vocabulary(path)
        counts, ids, told, decoded = [], [], [], []
        for found in v.encode_all(texts):
            raw = found.tobytes()
            counts.append(len(found))
            told.append(hashlib.sha256(raw).hexdigest())
            decoded.append(hashlib.sha256(v.decode(raw).encode()).hexdigest())
            if with_ids:
                ids.append(raw)
        columns = [pa.array(counts, pa.int64()), pa.array(told, pa.string()), pa.array(decoded, pa.string())]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
        return pa.StructArray.from_arrays(columns, names)

    kind = "n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + (",ids:binary" if with_ids else "")
    return F.arrow_udf(run, f"struct<{kind}>")


def _encoded(docs: DataFrame, path: str | None, with_ids: bool) -> DataFrame:
    texts = typed(docs, doc_id="bigint", text="string")
    return texts.select("doc_id", _digests(path or default_vocabulary(), with_ids)("text").alias("r")).select("doc_id", "r.*")


def token_rows(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (little-endian uint32) of every text.

    Every row gives a row, rows that repeat and null ids too; extra columns are
    ignored, an empty table gives no rows.
    """
    return _encoded(docs, path, True)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    return _encoded(docs, path, False)
