"""Suffix deduplication and the Jaccard join against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard, suffixes
from ledgerloom.llm.components import components
from tests.llm import cases


def brute_repeats(data):
    raw = [(t or "").encode() for _, t, *_ in data]
    seen: dict[bytes, int] = {}
    for b in raw:
        for j in range(len(b) - 399):
            w = b[j : j + 400]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (doc_id, *_), b in zip(data, raw, strict=True):
        gone = bytearray(len(b))
        for j in range(len(b) - 399):
            if seen[b[j : j + 400]] > 1:
                gone[j : j + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats(docs):
    out = suffixes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_repeats_match_brute_force(spark):
    data = [d for d in cases.rows() if d[0] != 305]
    got = repeats(cases.table(spark, data))
    assert got == brute_repeats(data)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("group", [3, 4096])
def test_passages_with_any_neighbours(spark, monkeypatch, group):
    """Shared passages between random bytes; a small limit forces splitting groups."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    r = random.Random(group)

    def some(k):
        return "".join(r.choice("abcd \n\0") for _ in range(k))

    passages = [some(k) for k in (399, 400, 401, 560, 1300)]
    data = []
    for i in range(50):
        text = "".join(some(r.randint(0, 300)) if r.random() < 0.5 else r.choice(passages)[r.randint(0, 20) :] for _ in range(4))
        data.append((i, text + "ab " * r.choice([0, 0, 200]), "en", "a"))
    assert repeats(cases.table(spark, data)) == brute_repeats(data)


def test_repeats_of_an_empty_table(spark):
    assert repeats(cases.empty(spark)) == []


def brute_classes(data):
    sets = {}
    for i, (_, t, *_) in enumerate(data):
        w = cases.plain_words(t)
        sets[i] = frozenset(" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    words = [" ".join(cases.plain_words(d[1])) for d in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {}
    for i in range(len(data)):
        similar = set()
        for j in range(len(data)):
            if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
                if words[i] != words[j]:
                    similar.add(words[j])
        links[i] = len(similar)
    classes = {}
    for i in range(len(data)):
        classes.setdefault(find(i), set()).add(data[i][0])

    def least(ids):
        return min(ids, key=lambda d: (d is not None, d))

    return {(d[0], least(classes[find(i)]), links[i]) for i, d in enumerate(data)}


def test_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)  # larger buckets and classes take several blocks
    data = cases.rows()
    got = jaccard.classes(cases.table(spark, data)).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == brute_classes(data)
    kept = [r.class_id for r in got if r.is_kept and r.doc_id not in (None, 300, 301, 302)]
    assert len(kept) == len(set(kept))


def test_one_row_of_each_class_stays(spark):
    data = cases.rows()
    kept = jaccard.drop_near_copies(cases.table(spark, data))
    assert kept.columns == cases.table(spark, data).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 1 and ids.count(200) == 0 and ids.count(3) == 1
    assert [i for i in ids if i is not None and 100 <= i < 112] == [100]
    assert {300, 301, 302, 308} <= set(ids) and 309 not in ids


def test_classes_of_an_empty_table(spark):
    assert jaccard.classes(cases.empty(spark)).collect() == []
    assert jaccard.drop_near_copies(cases.empty(spark)).collect() == []


def test_pruning_lets_similar_pairs_pass():
    least = jaccard.least_matches()
    assert len(least) == jaccard.HASHES // jaccard.CHUNK and least == sorted(least)
    for step, m in enumerate(least):
        assert m <= 0.8 * jaccard.CHUNK * (step + 1)


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40) if i % 10] + [(100, 200), (200, 100), (5, 5)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {(i, 10 * ((i - 1) // 10) + 1) for i in range(1, 41) if (i - 1) % 10}
    assert got == want | {(200, 100)}
