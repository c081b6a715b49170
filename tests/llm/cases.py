"""Small document tables with every awkward case, and brute-force versions."""

from __future__ import annotations

import random
import re

from pyspark.sql import SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_key string, node bigint, ranges int, _kept int, spans int"


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, repeated rows."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(400)]

    def prose(k: int) -> str:
        return " ".join(r.choice(words) for _ in range(k)).replace(" abc ", ".\n")

    shared = prose(90)
    out = []
    for i in range(n):
        text = prose(r.randint(1, 200))
        if i % 5 == 0:
            text += " " + shared
        if i % 7 == 0:
            text += "\ntoken = \"" + "".join(r.choice("0123456789abcdef") for _ in range(40)) + "\" ok"
        out.append((i, text, r.choice(["en", "fr", None]), r.choice(["a", "b", None])))
    base = prose(300)
    for i in range(12):  # near copies, one word changed
        w = base.split()
        w[10 * i + 5] = "changed"
        out.append((100 + i, " ".join(w), "en", "a"))
    out += [(200, out[3][1], "en", "a"), out[4], out[4]]  # an exact copy, a repeated row
    out += [(None, None, None, None), (300, None, "en", None), (301, "", "en", "a"), (302, " \n\t", "en", "b"), (None, "ab", "fr", "a")]
    out += [(303, "é" * 700, "fr", "b"), (304, "word " * 3000, "en", "a"), (305, prose(20_000), "en", "a"), (306, "x\0y\x85z 日本 😀", "zz", "q")]
    out += [(307, "<|endoftext|> a<|endoftext|>", "en", "a"), (308, "A B C, a-b c!", "en", "b"), (309, "a b c a B c", "en", "b")]
    return out


def table(spark: SparkSession, data: list[tuple]):
    """With extra columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(*d, len(d[1] or ""), "k", 7, 8, 9, 10) for d in data], SCHEMA)


def empty(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)


def plain_words(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
