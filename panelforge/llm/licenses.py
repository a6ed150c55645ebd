"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions alone.

A block is a window of words: for a template of up to H words (H the next power of two, 8 at least), the windows of
2 H words that start at every multiple of H, so each run of H words lies whole in one of them. A block carries a
template if it has at least ``threshold`` of the template's distinct words (containment).

1. One pass counts the templates' words over the whole corpus; the global order puts the rarest first.
2. Prefix filter: a block that lacks the first m - o + 1 of a template's m words in that order can't have o of them.
   Only blocks around such words are cut out, and each meets the templates by equality of the word.
3. Length filter: the block's words that any template has must be o at least. Positional filter: words before and
   after the shared one, in the block and in the template, bound what both can share.
4. What is left is verified exactly: the shared words are counted.

The templates are a query set of a few dozen texts, so their words and prefixes are a bounded broadcast. Blocks never
leave the task of their text; a text's findings are summed where they are before they are shuffled, so neither a
frequent passage nor a very long text gathers anywhere. No Python runs on the executors.

A null text counts as empty and has no words. Repeated rows are told apart by a row number. Empty tables give empty
results. Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
LEAST_WIDTH = 8
#: Phrases of the contract and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: The standard notices of public licenses and their labels.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("boost", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE or copy at http://www.boost.org/LICENSE_1_0.txt"),
    ("creative commons", "Licensed under CC BY-NC 4.0"),
    ("creative commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, null as empty. Other letters that become ASCII in lower case are only two; without them the faster ``lower`` finds the same words of ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains("\u0130") | text.contains("\u212a"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lowered(text), SEPARATORS), lambda w: w != "")


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of the places where the phrase's words stand one after the other."""
    first, *others = phrase.split()

    def here(word: Column, i: Column) -> Column:
        found = word == first
        for k, other in enumerate(others, 1):
            found = found & F.get(words, i + k).eqNullSafe(other)
        return F.when(found, i)

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    width: int  # H: half of a block
    words: tuple[str, ...]  # distinct, the rarest first
    least: int  # words that a block must have

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.least + 1]


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_counts(words: DataFrame, templates: Sequence[tuple[str, str]]) -> dict[str, int]:
    """How often the corpus has each word of the templates; the driver gets one number a word."""
    named = sorted({w for _, text in templates for w in plain_words(text)})
    each = words.select(F.explode("words").alias("word")).where(F.col("word").isin(named))
    return {r[0]: r[1] for r in each.groupBy("word").count().collect()}


def ordered_templates(templates: Sequence[tuple[str, str]], counts: dict[str, int], threshold: float) -> list[Template]:
    found = []
    for number, (label, text) in enumerate(templates):
        every = plain_words(text)
        distinct = tuple(sorted(set(every), key=lambda w: (counts.get(w, 0), w)))
        width = max(LEAST_WIDTH, 1 << (len(every) - 1).bit_length())
        found.append(Template(number, label, width, distinct, least_shared(len(distinct), threshold)))
    return found


def least_shared(n: int, threshold: float) -> int:
    return next(k for k in range(1, n + 1) if k / n >= threshold)


def global_order(templates: Sequence[Template], counts: dict[str, int]) -> list[str]:
    return sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))


def with_blocks(words: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """``words`` with ``blocks``: the windows (width, block, start, words) around the words of prefixes."""
    widths = sorted({t.width for t in templates})
    prefixes = {h: sorted({w for t in templates if t.width == h for w in t.prefix}) for h in widths}
    wanted = sorted({w for named in prefixes.values() for w in named})
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(wanted), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    found = words.withColumn("hits", hits)

    def around(h: int) -> Column:
        mine = F.filter("hits", lambda x: x["word"].isin(prefixes[h]))
        at = F.transform(mine, lambda x: F.floor(x["at"] / h).cast("int"))
        numbers = F.array_distinct(F.filter(F.concat(at, F.transform(at, lambda k: k - 1)), lambda k: k >= 0))
        return F.transform(numbers, lambda k: F.struct(F.lit(h).alias("width"), (k * h).cast("long").alias("start"), F.slice("words", k * h + 1, F.lit(2 * h)).alias("words")))

    return found.withColumn("blocks", F.concat(*(around(h) for h in widths))).drop("hits")


def _place(items: Column, item: Column) -> Column:
    return F.call_function("array_position", items, item)


def joined(blocks: DataFrame, templates: Sequence[Template], order: Sequence[str]) -> DataFrame:
    """The similarity join: each row of ``blocks`` (words and others) once for each template word of its prefixes, or once.

    ``template`` and ``containment`` are those of a template that the block has, else null.
    """
    index = [(t.width, w, p, t.number, len(t.words), t.least, list(t.words)) for t in templates for p, w in enumerate(t.prefix)]
    index = blocks.sparkSession.createDataFrame(index, "width int, word string, position int, number int, size int, least int, template_words array<string>")
    everything, prefix = list(order), sorted({w for t in templates for w in t.prefix})
    ranked = F.array_sort(F.transform(F.array_intersect("words", F.lit(everything)), lambda w: _place(F.lit(everything), w)))
    each = blocks.withColumn("ranked", ranked).withColumn("word", F.explode_outer(F.array_intersect("words", F.lit(prefix))))
    met = each.join(F.broadcast(index), ["width", "word"], "left")
    own, least = F.size("ranked"), F.col("least")
    at = _place(F.col("ranked"), _place(F.lit(everything), F.col("word"))) - 1
    bound = F.least(at, F.col("position")) + 1 + F.least(own - at - 1, F.col("size") - F.col("position") - 1)
    shared = F.when((own >= least) & (bound >= least), F.size(F.array_intersect("words", "template_words")))
    met = met.withColumn("shared", shared)
    has = F.col("shared") >= least
    kept = [c for c in blocks.columns if c not in ("width", "words")]
    return met.select(*kept, F.when(has, F.col("number")).alias("template"), F.when(has, F.col("shared") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is found in each row of ``docs``, one row a block and prefix word, or one row without a template.

    Columns: ``row``, id, ``n_words``; ``n_places``, ``first_place``, ``last_place`` and ``phrases`` (bits by number) of the
    phrases; ``start`` (the block's first word), ``n_block`` (its words), ``template`` (number) and ``containment``.
    """
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), words_of(F.col(f"`{text_col}`")).alias("words"))
    counts = template_counts(named, templates)
    sought = ordered_templates(templates, counts, threshold)
    rows = with_blocks(named, sought)
    anywhere = F.arrays_overlap("words", F.lit([p.split()[0] for p, _ in phrases]))
    places = F.when(anywhere, F.array(*(phrase_places(F.col("words"), p) for p, _ in phrases)))
    rows = rows.select("row", "id", F.size("words").cast("long").alias("n_words"), places.alias("places"), "blocks")
    every = F.flatten("places")
    bits = [F.when(F.size(F.get("places", F.lit(k))) > 0, 1 << k).otherwise(0) for k in range(len(phrases))]
    rows = rows.select(
        "row",
        "id",
        "n_words",
        F.coalesce(F.size(every), F.lit(0)).cast("long").alias("n_places"),
        F.array_min(every).cast("long").alias("first_place"),
        F.array_max(every).cast("long").alias("last_place"),
        sum(bits, F.lit(0)).cast("long").alias("phrases"),
        F.explode_outer("blocks").alias("block"),
    )
    inner = {"width": "block.width", "start": "block.start", "words": "block.words"}
    rows = rows.select(*(c for c in rows.columns if c != "block"), *(F.col(v).alias(k) for k, v in inner.items()), F.size("block.words").alias("n_block"))
    return joined(rows, sought, global_order(sought, counts))


def summed(found: DataFrame) -> DataFrame:
    """One row for each text of ``scan``: id, its words and places, ``templates`` (bits by number, up to 63) and the largest containment."""
    same = ("id", "n_words", "n_places", "first_place", "last_place", "phrases")
    bit = F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("template")), F.lit(0))
    return found.groupBy("row").agg(*(F.max(c).alias(c) for c in same), F.bit_or(bit).alias("templates"), F.max("containment").alias("containment")).drop("row")


def label_text(bits: Sequence[tuple[Column, Sequence[str]]]) -> Column:
    """Distinct sorted labels, joined by commas, of the numbers whose bits are set."""
    of: dict[str, Column] = {}
    for column, labels in bits:
        for k, label in enumerate(labels):
            on = column.bitwiseAND(F.lit(1 << k)) != 0
            of[label] = of[label] | on if label in of else on
    return F.concat_ws(",", *(F.when(on, F.lit(label)) for label, on in sorted(of.items())))


def license_blocks(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, **options) -> DataFrame:
    """id, ``label``, ``start``, ``n_block`` and ``containment`` of every block that has a template's words."""
    found = scan(docs, templates, **options).where("template is not null")
    label = F.get(F.lit([label for label, _ in templates]), F.col("template"))
    return found.select("row", "id", label.alias("label"), "start", "n_block", "template", "containment").distinct().drop("row", "template")
