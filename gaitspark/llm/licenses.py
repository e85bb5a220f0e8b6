"""License scans by an exact set-similarity join, in DataFrame operations alone.

Phrases are searched as consecutive words. Notices are found by containment: a text
block holds a template if it has at least ``percent`` of the template's distinct words.
Blocks are windows of words: two strides long, one stride apart, where the stride is
the first power of two that holds the template, so that any stretch as long as the
template lies whole in one of them, wherever lines break.

The join orders the templates' words by how often the corpus has them, rarest first.
- Prefix filter: a block at the threshold has one of a template's first
  n - need + 1 words, so only windows around those are looked at.
- Length filter: a block with fewer than ``need`` words of any template is out.
- Positional filter: where the first words met stand so late in both orders that what
  follows can't reach ``need``, the pair is out.
What remains is counted in full.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .urls import LOWER, UPPER

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_STRIDE = 16
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Fixed values: (label, words that a block must have besides, notice).
TEMPLATES = [
    ("mit", "mit license", "Released under the MIT License."),
    ("mit", "permission copies", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "apache 2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "apache 2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3", "gnu lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3", "gnu affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("gpl-2", "gnu general 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "gnu general 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "permission fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "public domain", "This is free and unencumbered software released into the public domain."),
    ("cc0", "cc0 public", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide under CC0."),
    ("cc-by", "cc by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "cc sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "cc nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "creative attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "creative sharealike", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "creative noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


def words_of(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]


class Template:
    """A notice's distinct words, how many of them a block needs, which it must have, and the stride of its blocks."""

    def __init__(self, number: int, label: str, names: str, text: str, percent: int):
        words = words_of(text)
        self.number, self.label, self.words, self.names = number, label, sorted({*words, *words_of(names)}), words_of(names)
        self.need = -(-percent * len(self.words) // 100)
        self.stride = max(LEAST_STRIDE, 1 << (len(words) - 1).bit_length())


def templates_of(notices: list[tuple[str, str, str]], percent: int) -> list[Template]:
    return [Template(i, *notice, percent) for i, notice in enumerate(notices)]


def covers(templates: list[Template]) -> list[tuple[int, int]]:
    """(template, another with the same stride and all of its words): where a block meets both, the first yields."""
    return [(a.number, b.number) for a in templates for b in templates if a.stride == b.stride and set(a.words) < set(b.words)]


def plain_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with single spaces between; null is empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, " "))


def _spaces(c: Column) -> Column:
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def phrase_places(line: Column, phrase: str) -> Column:
    """(n, first, last) of a phrase in ". words ": how often its words stand consecutively and the first words' numbers; null where they don't."""
    pieces = F.split(line, rf"(?= \Q{phrase}\E )")
    last = _spaces(line) - _spaces(F.element_at(pieces, -1))
    return F.when(F.contains(line, F.lit(f" {phrase} ")), F.struct((F.size(pieces) - 1).cast("long").alias("n"), _spaces(F.get(pieces, F.lit(0))).alias("first"), last.alias("last")))


def word_hits(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(a, b, pos, word) of every word of the vocabulary in docs (a, b, plain), written; word: its number there."""
    spark = docs.sparkSession
    known = spark.createDataFrame(list(zip(vocabulary, range(len(vocabulary)), strict=True)), "token string, word int")
    words = docs.select("a", "b", F.posexplode(F.split("plain", " ")).alias("pos", "token"))
    return materialize(words.join(F.broadcast(known), "token").select("a", "b", "pos", "word"), "words")


def notice_blocks(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(a, b, template, shared, start): the blocks of docs (a, b, plain) that meet a template, with the words shared and the block's first word's number."""
    spark = docs.sparkSession
    vocabulary = sorted({w for t in templates for w in t.words})
    hits = word_hits(docs, vocabulary)
    count = {r["word"]: r["n"] for r in hits.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each word of the templates at most
    order = sorted(range(len(vocabulary)), key=lambda i: (count.get(i, 0), vocabulary[i]))
    rank = {vocabulary[i]: r for r, i in enumerate(order)}
    sets = {t.number: sorted(rank[w] for w in t.words) for t in templates}
    prefixes = [(rank_, t.number, i, len(t.words), t.need, t.stride) for t in templates for i, rank_ in enumerate(sets[t.number][: len(t.words) - t.need + 1])]
    prefix = F.broadcast(spark.createDataFrame(prefixes, "rank int, template int, i int, size int, need int, stride int"))
    ranks = F.broadcast(spark.createDataFrame([(i, r) for r, i in enumerate(order)], "word int, rank int"))
    ranked = hits.join(ranks, "word").drop("word")

    windows = lambda stride: F.expr(f"filter(array(pos div {stride}, pos div {stride} - 1), w -> w >= 0)")
    near = ranked.join(F.broadcast(spark.createDataFrame(sorted({(p[0], p[5]) for p in prefixes}), "rank int, stride int")), "rank")
    blocks = materialize(near.select("a", "b", "stride", F.explode(windows("stride")).alias("w")).distinct(), "blocks")
    # Only words in the cells of such windows go on; a very long text is dealt out by its cells.
    cell = f"sequence(w * stride div {LEAST_STRIDE}, (w + 2) * stride div {LEAST_STRIDE} - 1)"
    cells = blocks.select("a", "b", F.explode(F.expr(cell)).alias("cell")).distinct()
    inside = ranked.withColumn("cell", F.expr(f"pos div {LEAST_STRIDE}")).join(cells, ["a", "b", "cell"], "left_semi")
    strides = F.array(*[F.lit(s) for s in sorted({t.stride for t in templates})])
    placed = inside.select("a", "b", "rank", "pos", F.explode(strides).alias("stride")).select("a", "b", "rank", "stride", F.explode(windows("stride")).alias("w"))
    held = placed.join(blocks, ["a", "b", "stride", "w"], "left_semi").groupBy("a", "b", "stride", "w").agg(F.sort_array(F.collect_set("rank")).alias("block"))

    least = min(t.need for t in templates)
    pairs = held.where(F.size("block") >= least).select("*", F.posexplode("block").alias("j", "rank")).join(prefix, ["rank", "stride"])
    pairs = pairs.where("need <= size(block) and 1 + least(size - i - 1, size(block) - j - 1) >= need").select("a", "b", "stride", "w", "block", "template").distinct()
    facts = [(t.number, sets[t.number], [rank[w] for w in t.names], t.need) for t in templates]
    facts = F.broadcast(spark.createDataFrame(facts, "template int, words array<int>, names array<int>, need int"))
    shared = pairs.join(facts, "template").withColumn("shared", F.size(F.array_intersect("block", "words"))).where("shared >= need and size(array_except(names, block)) = 0")
    met = shared.groupBy("a", "b", "stride", "w").agg(F.collect_list(F.struct("template", "shared")).alias("met"))
    larger = [(t.number, [b for a, b in covers(templates) if a == t.number]) for t in templates]
    above = F.broadcast(spark.createDataFrame(larger, "template int, above array<int>"))
    rows = met.select("a", "b", (F.col("w") * F.col("stride")).alias("start"), F.transform("met", lambda m: m["template"]).alias("all"), F.explode("met").alias("m"))
    rows = rows.select("a", "b", "start", "all", "m.template", "m.shared").join(above, "template").where("not arrays_overlap(above, all)")
    return rows.select("a", "b", "template", "shared", "start")


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str, str]] = TEMPLATES, percent: int = 80) -> DataFrame:
    """docs with n_words, places, notices: all that phrases and notices say of each whole text.

    docs needs doc_id and text. n_words counts the text's words. places has (label,
    phrase, n, first, last) of each phrase that stands in the text: how often, and the numbers
    of the first words of the first and the last place. notices has (label, containment, start) of
    each label that a block meets: the highest share of a template's words, and the
    first such block's first word. A template yields, within a block, to another that
    has all of its words and more. A null text is empty and has neither; a null doc_id
    and repeated rows get what their text has. Columns of docs keep their names unless
    they are called like one of the three, which are replaced.
    """
    if not phrases or not notices:
        raise ValueError("a scan needs phrases and notices")
    templates = templates_of(notices, percent)
    rows = docs.drop("n_words", "places", "notices")
    key = {"_a": F.xxhash64("doc_id"), "_b": F.xxhash64("text"), "_plain": plain_words(F.col("text"))}
    rows = rows.withColumns(key)
    found = notice_blocks(rows.select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_plain").alias("plain")), templates)
    line = F.concat(F.lit(". "), F.col("_plain"), F.lit(" "))
    places = [F.struct(F.lit(label).alias("label"), F.lit(phrase).alias("phrase"), phrase_places(line, phrase).alias("at")) for phrase, label in phrases]
    stated = F.transform(F.filter(F.array(*places), lambda p: p["at"].isNotNull()), lambda p: F.struct(p["label"].alias("label"), p["phrase"].alias("phrase"), p["at"]["n"].alias("n"), p["at"]["first"].alias("first"), p["at"]["last"].alias("last")))
    rows = rows.withColumns({"n_words": F.when(F.col("_plain") == "", 0).otherwise(_spaces(F.col("_plain")) + 1).cast("long"), "places": stated}).drop("_plain")
    best = found.join(F.broadcast(docs.sparkSession.createDataFrame([(t.number, t.label, len(t.words)) for t in templates], "template int, label string, size int")), "template")
    best = best.groupBy("a", "b", "label").agg(F.max(F.col("shared") / F.col("size")).alias("containment"), F.min("start").alias("start"))
    best = best.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("label", "containment", "start"))).alias("notices"))
    none = F.array().cast("array<struct<label:string,containment:double,start:bigint>>")
    return rows.join(best, ["_a", "_b"], "left").withColumn("notices", F.coalesce("notices", none)).drop("_a", "_b")
