"""License statements in texts: an exact set-similarity join of text blocks with statement templates.

A text block is a window of words; a new one starts every ``core`` words and takes in ``2 * core``,
so every passage of up to ``core + 1`` words lies whole in some block. A block meets a template when
it holds the wanted share of the template's distinct words. The join finds all such pairs without
comparing every block with every template: tokens are put in order of their frequency in all texts,
rarest first, and a pair must share a token in the prefixes of both. Length and position of the
shared token bound the overlap that is still possible; pairs that pass are verified. Built-in
functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
#: Templates are literals of the plan and a broadcast index: so many words of all templates at most.
MOST_WORDS = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """A statement. ``phrase``: its words must also stand consecutively, and all places count."""

    label: str
    text: str
    phrase: bool = False

    def words(self) -> list[str]:
        lowered = self.text.translate(str.maketrans(_UPPER, _LOWER))
        return "".join(c if c.isdigit() and c.isascii() or "a" <= c <= "z" or c > "\x7f" else " " for c in lowered).split(" ")


#: Short names of licenses, and sentences that license texts prescribe for notices.
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]
NOTICES = [
    Template("cc-by-nc", "cc by nc", True),
    Template("cc-by-sa", "cc by sa", True),
    Template("cc-by-nd", "cc by nd", True),
    Template("lgpl", "gnu lesser general public license", True),
    Template("agpl", "gnu affero general public license", True),
    Template("mpl", "mozilla public license", True),
    Template("bsd", "bsd license", True),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
             " Public License as published by the Free Software Foundation"),
    Template("gpl", "This work is licensed under the GNU General Public License"),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
             " compliance with the License"),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is"
             " distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
             " documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
             " the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
             " granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("all-rights", "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any"
             " form or by any means without the prior written permission of the publisher"),
]


def text_words(text: Column) -> Column:
    """Words of a text in order: A-Z in lower case, cut at all ASCII signs that are no letter or digit."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAKS), "")


def wanted(size: int, containment: float = CONTAINMENT) -> int:
    """Least number of shared words that makes the share of a template of ``size`` distinct words."""
    return max(1, math.ceil(containment * size - 1e-9))


def license_hits(
    docs: DataFrame,
    templates: Sequence[Template],
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_words`` and ``hits``, an array of all pairs of a block
    and a template that meet: ``template`` (its place in ``templates``), ``label``, ``at`` (first
    word of the block, from 0), ``containment`` and, for phrases, ``places``: the words at which it
    starts, each place in one hit only. A phrase without a place is no hit.

    Frequencies of the templates' words are counted over all texts; they decide the order of
    tokens and so the cost, not the result. Nothing is shuffled but ids, counts and hits.
    Null and empty texts have no words and no hits. Rows that repeat an id, or have none, are judged
    one by one. A long text is one array of its words, and its blocks without a prefix token go
    before anything is exploded. Only the two named columns are read, so extra columns don't matter.
    A template without words never meets.
    """
    spark = docs.sparkSession
    each = [(k, t, [w for w in t.words() if w]) for k, t in enumerate(templates)]
    each = [(k, t, w) for k, t, w in each if w]
    if sum(len(w) for _, _, w in each) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words: scan in several calls")
    vocabulary = sorted({x for _, _, w in each for x in w})
    texts = docs.select(F.col(id_col).alias("id"), text_words(F.col(text_col)).alias("words"))
    if not each:
        none = "array<struct<template:int,label:string,at:int,containment:double,places:array<int>>>"
        return texts.select("id", F.size("words").cast("long").alias("n_words"), F.array().cast(none).alias("hits"))

    counted = texts.select(F.explode("words").alias("word")).filter(F.col("word").isin(vocabulary))
    counts = {r["word"]: r["count"] for r in counted.groupBy("word").count().collect()}  # a row per word of the templates
    order = sorted(counts, key=lambda w: (counts[w], w))
    rank = {w: k for k, w in enumerate(order)}

    index, prefix_words, core, least = [], set(), max(len(w) for _, _, w in each), len(order)
    for k, t, words in each:
        # Words that no text has can't be shared: what is left must make the share without them.
        tokens = sorted(set(words) & set(order), key=rank.__getitem__)
        share = wanted(len(set(words)), 1.0 if t.phrase else containment)
        prefix = tokens[: max(0, len(tokens) - share + 1)]
        prefix_words.update(prefix)
        least = min(least, share) if prefix else least
        index += [(w, i, k, t.label, tokens, len(set(words)), share, words if t.phrase else None) for i, w in enumerate(prefix, 1)]
    schema = ("token string, i int, template int, label string, tokens array<string>, n_tokens int, share int,"
              " phrase array<string>")
    templates_by_token = spark.createDataFrame(index, schema)

    rare = lambda w: w.isin(sorted(prefix_words))
    ordered = F.lit(order) if order else F.array().cast("array<string>")
    starts = F.when(F.exists("words", rare), F.sequence(F.lit(0), F.size("words") - 1, F.lit(core)))
    blocks = F.filter(
        F.transform(starts, lambda s: F.struct(s.alias("at"), F.slice("words", s + 1, 2 * core).alias("words"))),
        lambda b: F.exists(b["words"], rare),
    )
    blocks = F.transform(blocks, lambda b: F.struct(b["at"], b["words"], F.array_intersect(ordered, b["words"]).alias("tokens")))
    keyed = texts.select(F.monotonically_increasing_id().alias("key"), "id", F.size("words").cast("long").alias("n_words"),
                         blocks.alias("blocks"))
    block_rows = keyed.select("key", "id", "n_words", F.explode_outer("blocks").alias("b"))
    size = F.size("b.tokens")
    prefix = F.slice("b.tokens", 1, F.greatest(size - least + 1, F.lit(0)))
    token_rows = block_rows.select("key", "id", "n_words", "b", F.posexplode_outer(prefix).alias("j", "token"))

    t = F.broadcast(templates_by_token.withColumnRenamed("tokens", "t_tokens"))
    size, j = F.size("b.tokens"), F.col("j") + 1
    possible = F.least("i", j) + F.least(F.size("t_tokens") - F.col("i"), size - j)
    # Of all tokens that a pair shares the first one stands for it, so each pair comes once.
    first = F.size(F.array_intersect(F.slice("t_tokens", 1, F.col("i") - 1), F.slice("b.tokens", 1, j - 1))) == 0
    paired = token_rows.join(t, "token", "left")
    candidate = (
        F.col("template").isNotNull() & (size >= F.col("share")) & (j <= size - F.col("share") + 1)
        & (possible >= F.col("share")) & first
    )
    overlap = F.when(candidate, F.size(F.array_intersect("t_tokens", "b.tokens")))
    found = paired.select("key", "id", "n_words", "b", "template", "label", "phrase", "share",
                          "n_tokens", overlap.alias("overlap"))
    stands = lambda p: (F.get(F.col("b.words"), p) == F.get(F.col("phrase"), F.lit(0))) & (
        F.slice("b.words", p + 1, F.size("phrase")) == F.col("phrase"))
    inside = F.filter(F.sequence(F.lit(0), F.lit(core - 1)), stands)
    places = F.when((F.col("overlap") >= F.col("share")) & F.col("phrase").isNotNull(),
                    F.transform(inside, lambda p: p + F.col("b.at")))
    met = (F.col("overlap") >= F.col("share")) & (F.col("phrase").isNull() | (F.size("places") > 0))
    hit = F.struct("template", "label", F.col("b.at").alias("at"), (F.col("overlap") / F.col("n_tokens")).alias("containment"),
                   "places")
    return (
        found.withColumn("places", places)
        .groupBy("key").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"),
                            F.collect_list(F.when(met, hit)).alias("hits"))
        .select("id", "n_words", "hits")
    )


def license_scan(docs: DataFrame, base: Sequence[Template], more: Sequence[Template], **how) -> DataFrame:
    """One row per row of ``docs``, from :func:`license_hits`: ``id``, ``n_words``, ``n_base`` (all
    places of the base phrases), ``first_word`` and ``last_word`` (their smallest and largest start, else null),
    ``base_labels`` and ``labels`` (distinct, sorted, joined by commas), ``score`` (largest share
    of a template that a block holds among the hits, 0 without hits) and ``hits``."""
    found = license_hits(docs, [*base, *more], **how)
    of_base = F.filter("hits", lambda h: h["template"] < len(base))
    places = F.flatten(F.transform(of_base, lambda h: h["places"]))
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return found.select(
        "id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        labels(of_base).alias("base_labels"), labels(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["containment"])), F.lit(0.0)).alias("score"), "hits",
    )
