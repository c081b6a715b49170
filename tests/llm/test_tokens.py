"""Encoding, decoding and the token files against the tokenizers library."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, repair
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    r = random.Random(4)
    out = [t for _, t, *_ in cases.rows() if t]
    out += ["", "'s", "'", "a'l", "don't we've 'sabc x'll'd 're  'tis\n's y're'", "a" * 3000, " " * 500 + "x", "\n\n x \n"]
    signs = " \n\t\r\x1c\x85 ab1''svelrtmd stſé.!?日本😀​"
    return out + ["".join(r.choice(signs) for _ in range(150)) for _ in range(200)]


def test_ids_and_text_equal_the_library(library):
    v = bpe.Vocabulary(PATH)
    every = texts()
    for text, ids in zip(every, v.encode_all(pa.array(every)), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert v.decode(ids.tobytes()) == library.decode(ids.tolist(), skip_special_tokens=False) == text


def test_a_full_cache_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED", 50)
    v = bpe.Vocabulary(PATH)
    every = texts()[:60]
    for _ in range(2):
        assert [i.tolist() for i in v.encode_all(pa.array(every))] == [library.encode(t, add_special_tokens=False).ids for t in every]


def test_a_worker_starts_in_bounded_memory():
    """The table of classes held lists of all letters, 50 MB and more, in every worker at once."""
    want = bpe._classes()
    tracemalloc.start()
    try:
        assert (bpe._classes.__wrapped__() == want).all()
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()


def test_small_slices_and_blocks_change_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "ENCODED_BYTES", 64)
    monkeypatch.setattr(bpe, "TOLD", 3)
    every = texts()
    got = [i.tolist() for i in bpe.Vocabulary(PATH).encode_all(pa.array(every))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in every]


def test_ids_that_are_no_text_decode_like_the_library(library):
    v = bpe.Vocabulary(PATH)
    r = random.Random(8)
    for _ in range(100):
        ids = [r.randrange(50257) for _ in range(6)]
        assert v.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_digests(spark, library):
    data = cases.rows()
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(cases.table(spark, data)).collect()), key=str)
    import hashlib

    want = []
    for doc_id, text, *_ in data:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((
            doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        ))
    assert got == sorted(want, key=str)
    assert bpe.token_digests(cases.empty(spark)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_blocks_round_trip(seed):
    r = random.Random(seed)
    docs = [np.array([r.choice([1, 2, 3, 3, 3, 50_000]) for _ in range(r.choice([0, 1, 2, 900]))], np.uint32) for _ in range(40)]
    docs += [np.full(2001, 7, np.uint32), np.tile([1, 2], 700).astype(np.uint32), np.array([2], np.uint32)]
    block = repair.Block(repair.compress(docs, 50_257))
    assert len(block.rules) and len(block.symbols) < sum(map(len, docs))
    for i, ids in enumerate(docs):
        assert block.document(i).tolist() == ids.tolist()
        assert [block.id_at(i, k) for k in range(0, len(ids), 97)] == ids[::97].tolist()
    assert block.all_ids().tolist() == np.concatenate(docs).tolist()
    every = np.concatenate([np.ones(50_257, int), block.lengths])
    assert all(every[50_257 + k] == every[a] + every[b] for k, (a, b) in enumerate(block.rules.tolist()))


@pytest.mark.parametrize("most", [1, 7, 1_000])
def test_no_frequent_pair_is_left(monkeypatch, most):
    monkeypatch.setattr(repair, "PAIRS", most)
    r = random.Random(most)
    passage = [r.randrange(50_000) for _ in range(30)]
    docs = [np.array([r.randrange(12) for _ in range(200)] + passage * r.randrange(3), np.uint32) for _ in range(60)]
    docs += [np.zeros(0, np.uint32), np.zeros(1_000, np.uint32), *([np.array(passage, np.uint32)] * 40)]
    block = repair.Block(repair.compress(docs, 50_257))
    assert [block.document(i).tolist() for i in range(len(docs))] == [d.tolist() for d in docs]
    left: dict[tuple[int, int], int] = {}
    for a, b in zip(block.symbol_ends, block.symbol_ends[1:]):
        kept = block.symbols[a:b].tolist()
        for pair in zip(kept, kept[1:]):
            left[pair] = left.get(pair, 0) + 1
    assert max(left.values()) < repair.LEAST and len(block.symbols) < 0.6 * sum(map(len, docs))


def test_rare_pairs_of_full_buckets_do_not_hide_frequent_ones(monkeypatch):
    monkeypatch.setattr(repair, "_BUCKETS", 1)  # nearly all pairs share a bucket
    monkeypatch.setattr(repair, "PAIRS", 1)
    docs = [np.array([i, i + 9_000], np.uint32) for i in range(9_000)] + [np.array([3, 5, 3, 5], np.uint32)] * 30
    block = repair.Block(repair.compress(docs, 50_257))
    assert [3, 5] in block.rules.tolist()
    assert block.all_ids().tolist() == np.concatenate(docs).tolist()


def test_files_hold_all_documents_in_order(spark, tmp_path, library, monkeypatch):
    data = cases.rows()
    path = str(tmp_path / "ids")
    repair.write_ids(cases.table(spark, data), path)
    got = sorted(repair.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(data) and got[0].start == 0
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(d[0] for d in data if d[0] is not None)
    assert [r.doc_id for r in got[:2]] == [None, None]
    for a, b in zip(got, got[1:], strict=False):
        assert b.start == a.start + a.n_tokens
    want = {}
    for doc_id, text, *_ in data:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, repair.END_ID]
        want.setdefault(doc_id, set()).add((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert all((r.n_tokens, r.ids_crc32) in want[r.doc_id] for r in got)
    alone = {r.doc_id: r.ids for r in repair.documents_of(spark, path).collect()}
    assert alone[301] == [repair.END_ID]
    repair.write_ids(cases.empty(spark), str(tmp_path / "none"))
    assert repair.read_digests(spark, str(tmp_path / "none")).collect() == []
