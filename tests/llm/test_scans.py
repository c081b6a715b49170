"""License scan, source divergence and cross-tokenizer alignment against brute force."""

import bisect
import hashlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest

from ledgerloom.llm import align, bpe, divergence, licenses
from ledgerloom.llm import textvec as tv
from tests.llm import cases

NOTICES = [
    (400, "x Released under the\nMIT License. under the mit license", "en", "a"),
    (401, "This work is licensed under the GNU Lesser General Public License, version 3.", "en", "a"),
    (402, "This work is licensed under the GNU General Public License, version 3.", "en", "b"),
    (403, "Released under the BSD license; all rights are reserved here " * 40, "en", "b"),
    (404, "cc by nc CC-BY-NC cc by nc", "fr", "a"),
    (405, "filler " * 500 + "Permission is hereby given, free of charge, to any person obtaining a copy of this software: granted", "en", "a"),
    (406, "This work is licensed under a Creative Commons Attribution 4.0 International License", "en", "a"),
    (407, "Licensed under the Apache License, Version 2.0. ALL RIGHTS RESERVED", None, None),
]


# -- license scan --------------------------------------------------------------------------


def scanned(text):
    w = cases.plain_words(text)
    bases = [(label, i) for label, phrase in licenses.BASE_PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    kept, share = set(), 0.0
    for step in licenses.STEPS:
        for b in range(-(-len(w) // step)):
            held = set(w[b * step : (b + 2) * step])
            met = []
            for t in licenses.default_templates():
                found = held & set(t.words)
                if t.step == step and len(found) >= t.least and set(t.needed) <= found:
                    met.append((len(found) / len(t.words), len(found), found, t.label))
            for m in met:
                if not any(m[2] <= o[2] and o[:2] > m[:2] for o in met):
                    kept.add(m[3])
                    share = max(share, m[0])
    own = {label for label, _ in bases}
    starts = [i for _, i in bases]
    return (
        len(w), len(bases), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(own)), ",".join(sorted(own | kept)), 1.0 if bases else share,
    )


def test_license_scan_equals_brute_force(spark):
    data = cases.rows() + NOTICES + NOTICES[:1]
    got = Counter(tuple(r) for r in licenses.scan(cases.table(spark, data)).collect())
    assert got == Counter((d[0], *scanned(d[1])) for d in data)
    labels = {r[0]: r[6] for r in got}
    assert labels[401] == "lgpl-3" and labels[402] == "gpl-3" and labels[403] == "all-rights-reserved" and labels[406] == "cc-by"
    assert labels[405] == "mit" and labels[407] == "all-rights-reserved,apache-2"


def test_license_scan_of_an_empty_table(spark):
    assert licenses.scan(cases.empty(spark)).count() == 0


def test_long_templates_are_refused():
    with pytest.raises(ValueError):
        licenses.template("x", "word " * 65, "word")


# -- source divergence ---------------------------------------------------------------------


def diverging(data, min_docs, top):
    docs = []
    for _, text, lang, source in data:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        letters = "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in lowered)
        docs.append((lang or "", source or "", letters.split(" ")))
    seen, counts = defaultdict(int), defaultdict(int)
    for lang, source, terms in docs:
        for t in set(terms) - {""}:
            seen[lang, t] += 1
        for t in terms:
            counts[lang, source, t] += t != ""
    kept = defaultdict(list)
    for (lang, t), n in seen.items():
        if n >= min_docs:
            kept[lang].append(t)
    groups = {(lang, source) for lang, source, _ in docs}

    def shares(lang, sources):
        n = {t: sum(counts[lang, s, t] for s in sources) for t in kept[lang]}
        return n, {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(n)) for t in n}

    rows = []
    for lang, source in groups:
        n, p = shares(lang, [source])
        mates = [s for g, s in groups if g == lang]
        _, q = shares(lang, mates)
        others = []
        for other in set(mates) - {source}:
            _, o = shares(lang, [other])
            others.append((sum((p[t] - o[t]) ** 2 // o[t] for t in p), other))
        terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in p if n[t] and p[t] > q[t]]
        for part, found, most in (("pair", others, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            rows += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return Counter(rows)


@pytest.mark.parametrize("held", [divergence.PAIRS_HELD, 3])
@pytest.mark.parametrize("min_docs, top", [(3, 200), (1, 7), (10**6, 5)])
def test_divergence_equals_brute_force(spark, monkeypatch, held, min_docs, top):
    monkeypatch.setattr(divergence, "PAIRS_HELD", held)
    data = [d for d in cases.rows() if len(d[1] or "") < 50_000]
    data += [(500 + i, f"rare{'abcdefgh'[i % 8]} ütf zebra{'xyz'[i % 3]} the the", "en", f"s{i % 4}") for i in range(24)]
    got = divergence.divergence(cases.table(spark, data), min_docs, top)
    assert Counter(tuple(r) for r in got.collect()) == diverging(data, min_docs, top)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(cases.empty(spark)).count() == 0


def test_shares_beyond_64_bits(spark):
    row = spark.sql("select 90000000000000L as n, 100000000000000L as size, 7L as v")
    got = row.select(divergence._share("n", "size").alias("p")).first().p
    assert got == 1 + 10**9 * (90000000000000 + 1) // (100000000000000 + 7)


# -- alignment -----------------------------------------------------------------------------


def aligned(data):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = bpe.byte_letters()

    def bytes_a(i):
        return bytes(letters[c] for c in one.id_to_token(i))

    def bytes_b(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    rows, linked, counts = [], [], Counter()
    for row in data:
        text = row[1] or ""
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        spelled = [b"".join(map(bytes_a, a)), b"".join(map(bytes_b, b))]
        if not text or spelled != [(" " + text).encode()] * 2:
            rows.append((row[0], 0, 0, 0, 0, ""))
            linked.append(Counter())
            continue
        ends_a, ends_b = np.cumsum([len(bytes_a(i)) for i in a]).tolist(), np.cumsum([len(bytes_b(i)) for i in b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in common]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for i, end in zip(ids, ends, strict=True):
                groups[bisect.bisect_left(common, end)][side].append(i)
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        links = Counter((i, j) for x, y in groups for i in x for j in y)
        counts.update(links.keys())
        linked.append(links)
        rows.append((row[0], len(a), len(b), len(common), links.total(), hashlib.sha256(told.encode()).hexdigest()))
    highest = defaultdict(int)
    for (i, _), n in counts.items():
        highest[i] = max(highest[i], n)
    return Counter(
        (*r[:5], sum(n for k, n in l.items() if counts[k] == highest[k[0]]), sum(n * counts[k] for k, n in l.items()), r[5])
        for r, l in zip(rows, linked, strict=True)
    )


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


AWKWARD = [
    (600, "  two  spaces \n\n and\t tabs \n", "en", "a"), (601, "a▁b", "en", "a"), (602, "</s><s><unk><0x0A> <|endoftext|>", "en", "a"),
    (603, "a" * 900 + "中文字符" * 200, "zz", "a"), (604, " ", "en", "a"), (605, "\n", "en", "a"), (606, "ﬁ é é 　x", "en", "a"),
    (607, thue_morse(1024), "en", "a"), (608, thue_morse(1024).translate({97: 98, 98: 97}), "en", "a"), (609, "don't we'll 12345 ?!?!", "en", "a"),
]


@pytest.mark.parametrize("block, wide", [(align.BLOCK_BYTES, align.WIDE), (3000, 1)])
def test_alignment_equals_brute_force(spark, monkeypatch, block, wide):
    monkeypatch.setattr(align, "BLOCK_BYTES", block)
    monkeypatch.setattr(align, "WIDE", wide)
    data = [d for d in cases.rows() if len(d[1] or "") < 50_000] + AWKWARD + AWKWARD[:1]
    got = align.alignments(cases.table(spark, data).repartition(3))
    assert Counter(tuple(r) for r in got.collect()) == aligned(data)


def test_alignment_of_an_empty_table(spark):
    assert align.alignments(cases.empty(spark)).count() == 0


def test_diagonal_runs_find_all_shared_ends():
    rng = np.random.default_rng(3)
    for density in (0.02, 0.3, 0.9):
        last = 5000
        a, b = (sorted({*rng.choice(last, int(density * last), replace=False).tolist(), last}) for _ in range(2))
        cut_a, cut_b = align.group_ends(a, b)
        common = sorted(set(a) & set(b))
        assert np.array(a)[cut_a].tolist() == common == np.array(b)[cut_b].tolist()


# -- hashes --------------------------------------------------------------------------------


def test_span_hashes_tell_thue_morse_strings_apart():
    words = [thue_morse(n).encode() for n in (1024, 4096)]
    words += [w.translate(bytes.maketrans(b"ab", b"ba")) for w in words]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    hashes = tv.PrimeHashes(data).of(ends - [len(w) for w in words], ends)
    assert len(set(hashes.tolist())) == len(words)


def test_span_hashes_are_the_same_anywhere(monkeypatch):
    monkeypatch.setattr(tv, "_CHUNK", 7)
    data = np.frombuffer(b"abcdefgh" * 40, np.uint8)
    starts = np.arange(0, 312, 8)
    assert len(set(tv.PrimeHashes(data).of(starts, starts + 8).tolist())) == 1
    assert all(x != y for x, y in pairwise(tv.PrimeHashes(data).of(starts, starts + 7 + np.arange(39) % 2).tolist()))
