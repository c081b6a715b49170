"""License scan as an exact set-similarity join of text blocks and license templates.

A template is a notice or clause that license texts consist of. A text is cut
into overlapping blocks: for a template of at most ``step`` words, windows of
``2 * step`` words begin every ``step`` words, so that each run of that many
words lies whole in a block. A block meets a template if it holds at least
``THRESHOLD`` of the template's distinct words, the words it names as needed
among them.

The words of all templates are ordered by how often they occur in the whole
corpus, rarest first. The join uses three filters that lose no pair:

* prefix: of a template's n words, need = ceil(THRESHOLD * n) must be found, so
  one of the first n - need + 1 in that order is; blocks are looked up by those.
* length: a block with fewer than need words of any template cannot qualify.
* position: a pair is looked at where its rarest shared word meets; what comes
  behind that word on both sides bounds what they can share.

What is left is verified exactly. A match is dropped where another one of the
block holds the same words or more at a higher share (a notice that is part of
a longer one). Base places, where a fixed phrase stands word by word, are
found in the same words and their labels always stay.

``score`` is the highest share of a document's matches, 1 with a base place, 0
with neither. Null text has no words. Documents are told apart by (doc_id,
text): rows that repeat get equal results. Extra columns are ignored, an empty
table gives no rows, ties between templates keep both labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_BYTES, text_key, typed
from ledgerloom.llm.decontaminate import words_of
from ledgerloom.session import materialise

THRESHOLD = 0.8
STEPS = (4, 8, 16, 32, 64)

# The phrases of base places and their labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Label, notice or clause, words needed.
TEMPLATES = (
    ("mit", "Released under the MIT License", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission granted charge"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "permission notice portions"),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache 2"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "compliance obtain"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", "gnu general 3"),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3", "gnu lesser 3"),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3", "gnu affero 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission fee granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc nc"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "commons noncommercial"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "commons sharealike"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "commons attribution"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    ("all-rights-reserved", "All rights reserved", "reserved"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]  # distinct
    needed: tuple[str, ...]
    step: int
    least: int  # words a block must hold


def template(label: str, text: str, needed: str, threshold: float = THRESHOLD) -> Template:
    spoken = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    words = tuple(dict.fromkeys(spoken))
    step = next((s for s in STEPS if s >= len(spoken)), None)
    if step is None:
        raise ValueError(f"a template has at most {STEPS[-1]} words: {label}")
    return Template(label, words, tuple(needed.split()), step, math.ceil(threshold * len(words) - 1e-9))


def default_templates() -> list[Template]:
    return [template(*t) for t in TEMPLATES]


def _documents(docs: DataFrame) -> DataFrame:
    return typed(docs, doc_id="bigint", text="string").select(
        "doc_id", text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("words")
    )


def rarity_order(documents: DataFrame, templates: list[Template]) -> list[str]:
    """All words of the templates, those rarest in the whole corpus first.

    One count per word comes back, as many as the templates have words.
    """
    words = sorted({w for t in templates for w in t.words})
    wanted = documents.sparkSession.createDataFrame([(w,) for w in words], "word string")
    seen = documents.select(F.explode("words").alias("word")).join(F.broadcast(wanted), "word")
    counts = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _anchors(spark, templates: list[Template], order: list[str]) -> DataFrame:
    """word, place_in, and the template it leads to: the prefix of each template."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for number, t in enumerate(templates):
        words = sorted(t.words, key=rank.__getitem__)
        for i, word in enumerate(words[: len(words) - t.least + 1]):
            rows.append((word, i, number, t.label, words, list(t.needed), t.step, t.least))
    schema = "word string, place_in int, number int, label string, tokens array<string>, needed array<string>, step int, least int"
    size = sum(64 + sum(map(len, r[4])) for r in rows)
    found = spark.createDataFrame(rows, schema)
    return F.broadcast(found) if size <= BROADCAST_BYTES else found


def matches(documents: DataFrame, templates: list[Template]) -> DataFrame:
    """doc_id, text_key, step, block, number, label, found, share: every block that meets a template."""
    order = rarity_order(documents, templates)
    anchors = _anchors(documents.sparkSession, templates, order)
    here = F.expr("cast(place div step as int)")
    met = (
        documents.select("doc_id", "text_key", "words", F.posexplode("words").alias("place", "word"))
        .join(anchors, "word")
        .select("*", F.explode(F.array(here, here - 1)).alias("block"))
        .where(F.col("block") >= 0)
        .select(
            "doc_id", "text_key", "word", "place_in", "number", "label", "tokens", "needed", "step", "least", "block",
            (F.col("place") - F.col("block") * F.col("step")).alias("within"),
            F.slice("words", F.col("block") * F.col("step") + 1, 2 * F.col("step")).alias("held"),
        )
        .where(F.array_position("held", F.col("word")) == F.col("within") + 1)
    )
    known = F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("held"))
    behind = F.least(
        F.size("tokens") - 1 - F.col("place_in"), F.size("known") - F.array_position("known", F.col("word")).cast("int")
    )
    near = met.withColumn("known", known).where((F.size("known") >= F.col("least")) & (behind + 1 >= F.col("least")))
    found = F.array_intersect("tokens", "held")
    return (
        near.withColumn("found", found)
        .where((F.size("found") >= F.col("least")) & (F.element_at("found", 1) == F.col("word")))
        .where(F.size(F.array_except("needed", "found")) == 0)
        .select(
            "doc_id", "text_key", "step", "block", "number", "label", "found",
            (F.size("found") / F.size("tokens")).alias("share"),
        )
    )


def _outdone(m: Column, others: Column) -> Column:
    """Whether another match of the block has all of this one's words and is the better one."""

    def better(o: Column) -> Column:
        more = (o["share"] > m["share"]) | ((o["share"] == m["share"]) & (F.size(o["found"]) > F.size(m["found"])))
        return more & (F.size(F.array_except(m["found"], o["found"])) == 0)

    return F.exists(others, better)


def best_matches(found: DataFrame) -> DataFrame:
    """Per document: labels (distinct, sorted) and score. A block has a row per template at most."""
    block = (
        found.groupBy("doc_id", "text_key", "step", "block")
        .agg(F.collect_list(F.struct("label", "found", "share")).alias("all"))
        .select("doc_id", "text_key", F.filter("all", lambda m: ~_outdone(m, F.col("all"))).alias("kept"))
        .select("doc_id", "text_key", F.explode("kept").alias("m"))
        .groupBy("doc_id", "text_key", F.col("m.label").alias("label"))
        .agg(F.max("m.share").alias("share"))
    )
    return block.groupBy("doc_id", "text_key").agg(F.collect_list("label").alias("found_labels"), F.max("share").alias("found_share"))


def _places(phrase: str) -> Column:
    """First words of the phrase's places in ``words``, ascending."""
    wanted = phrase.split()
    starts = F.sequence(F.lit(0), F.size("words") - len(wanted))

    def here(i: Column) -> Column:
        same = F.lit(True)
        for k, word in enumerate(wanted):
            same = same & (F.get("words", i + k) == word)
        return same

    held = F.size("words") >= len(wanted)
    for word in dict.fromkeys(wanted):
        held = held & F.array_contains("words", word)
    return F.when(held, F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row."""
    templates = default_templates() if templates is None else templates
    documents = _documents(docs)
    found = materialise(best_matches(matches(documents, templates)))
    found = found.withColumnsRenamed({"doc_id": "found_id", "text_key": "found_key"})
    names = [f"base_{i}" for i in range(len(BASE_PHRASES))]
    based = documents.select(
        "doc_id", "text_key", F.size("words").cast("long").alias("n_words"),
        *[_places(phrase).alias(name) for name, (_, phrase) in zip(names, BASE_PHRASES, strict=True)],
    )
    starts = F.concat(*names)
    labels = F.array_compact(F.array(*[
        F.when(F.size(name) > 0, F.lit(label)) for name, (label, _) in zip(names, BASE_PHRASES, strict=True)
    ]))
    placed = based.select(
        "doc_id", "text_key", "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels.alias("own"),
    )
    both = placed.join(
        found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left"
    )
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_distinct(F.concat("own", F.coalesce("found_labels", none))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("own")), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("found_share", F.lit(0.0))).alias("score"),
    )
