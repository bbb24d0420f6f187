"""License texts by an exact set-similarity join with templates.

A block of a text matches a template if it holds at least `threshold` of the template's different words. Blocks are windows of consecutive
words, whatever lines they stand in: twice as long as the longest template, one beginning every such length, so that any run of words
as long as a template lies in one of them whole.
Only words of some template can count, so blocks are reduced to these, ordered from rare to frequent by the texts that hold them. With
n = ceil(threshold * template size):

* length: a block with fewer than n such words cannot match;
* prefix: block and template share a word among the first (size - n + 1) of each;
* position: at a shared word, fewer than n words left on either side rule the pair out;
* what remains is verified on the whole sets.

Templates are a parameter of a few kilobytes; only blocks that hold a word of a template's prefix leave their text. Base phrases
are found beside that, by place. Null texts have no words. Repeated rows each keep their row, an empty table gives no row, and only
the named columns are read.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NOT_WORD, lower_ascii, words_between

# Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Sentences of public licenses.
TEMPLATES = (
    ("agpl-3.0", "GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("epl-2.0", "are made available under the terms of the Eclipse Public License 2.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text: str) -> list[str]:
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text))


def words_of(text: Column) -> Column:
    return words_between(lower_ascii(text), NOT_WORD)


def constant(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of a phrase among the words."""
    parts = phrase.split()

    def fits(i: Column) -> Column:
        return reduce(and_, (F.element_at(words, i + k + 1) == part for k, part in enumerate(parts)))

    last = F.size(words) - len(parts)
    return F.when(last < 0, F.expr("CAST(array() AS array<int>)")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), fits))


def with_base(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The kept columns, `n_words`, and per phrase the places of its words in `_p0`, `_p1`, ..."""
    gap = NOT_WORD[:-1] + "+"
    maybe = "|".join(phrase.replace(" ", gap) for phrase, _ in PHRASES)
    low = docs.select(*keep, lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    split = low.select(*keep, F.col("_low").rlike(maybe).alias("_maybe"), words_between(F.col("_low"), NOT_WORD).alias("_words"))
    none = F.expr("CAST(array() AS array<int>)")
    return split.select(*keep, F.size("_words").cast("bigint").alias("n_words"),
                        *(F.when(F.col("_maybe"), phrase_places(F.col("_words"), p)).otherwise(none).alias(f"_p{k}") for k, (p, _) in enumerate(PHRASES)))


def matches(docs: DataFrame, keep: list[str], text: str, threshold: float, templates=TEMPLATES) -> DataFrame:
    """`keep`, `label` and `containment` for every pair of a block and a template that it matches."""
    spark = docs.sparkSession
    sets = [(label, sorted(set(word_list(t)))) for label, t in templates]
    vocabulary = sorted({w for _, words in sets for w in words})
    stride = max(len(word_list(t)) for _, t in templates)
    texts = docs.select(*keep, words_of(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    counted = texts.select(F.explode(F.array_intersect("_words", constant(vocabulary))).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counted.collect()}  # at most one row per word of the templates
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    rows, prefixes = [], set()
    for number, (label, words) in enumerate(sets):
        words = sorted(words, key=rank.get)
        need = math.ceil(threshold * len(words) - 1e-9)
        for place, w in enumerate(words[:len(words) - need + 1]):
            prefixes.add(w)
            rows.append((number, label, w, place, len(words), need, words))
    least = min(r[5] for r in rows)
    sides = spark.createDataFrame(rows, "template int, label string, word string, t_place int, t_size int, need int, t_words array<string>")
    asked, some_words = constant(order), constant(sorted(prefixes, key=rank.get))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("_words") - 1, F.lit(0)) / stride).cast("int"))
    held = F.transform(starts, lambda k: F.array_intersect(asked, F.slice(F.col("_words"), k * stride + 1, F.lit(2 * stride))))  # in the order of `order`
    enough = F.filter(held, lambda words: (F.size(words) >= least) & F.arrays_overlap(words, some_words))
    some = texts.where(F.arrays_overlap("_words", some_words)).select(*keep, F.explode(enough).alias("_held"))
    prefix = F.slice(F.col("_held"), F.lit(1), F.size("_held") - least + 1)
    probes = some.select(*keep, "_held", F.size("_held").alias("_size"), F.posexplode(prefix).alias("_place", "word"))
    # Broadcast bound: the templates' prefixes, a parameter.
    pairs = probes.join(F.broadcast(sides), "word").where(
        (F.col("_size") >= F.col("need")) & (F.col("_place") <= F.col("_size") - F.col("need"))
        & (F.least(F.col("_size") - F.col("_place"), F.col("t_size") - F.col("t_place")) >= F.col("need")))
    common = F.size(F.array_intersect("_held", "t_words"))
    return pairs.where(common >= F.col("need")).select(*keep, "label", (common / F.col("t_size")).alias("containment"))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.9) -> DataFrame:
    """`id`, `n_words`, `base` (label, start) in order of start, `labels` of the join, sorted, and their best `containment`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(id).alias("_id"), F.xxhash64(whole).alias("_h1"), F.xxhash64(F.lit(1), whole).alias("_h2"), F.col(text).alias("_text"))
    keys = ["_id", "_h1", "_h2"]
    based = with_base(keyed, keys, "_text")
    found = matches(keyed, keys, "_text", threshold).groupBy(*keys).agg(
        F.array_sort(F.collect_set("label")).alias("labels"), F.max("containment").alias("containment"))
    other = found.select(*(F.col(k).alias(f"{k}_found") for k in keys), "labels", "containment")
    same = F.col("_id").eqNullSafe(F.col("_id_found")) & (F.col("_h1") == F.col("_h1_found")) & (F.col("_h2") == F.col("_h2_found"))
    labelled = lambda label: lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))
    places = F.concat(*(F.transform(f"_p{k}", labelled(label)) for k, (_, label) in enumerate(PHRASES)))
    return based.join(other, same, "left").select(
        F.col("_id").alias(id), "n_words", F.array_sort(places).alias("base"),
        F.coalesce("labels", F.expr("CAST(array() AS array<string>)")).alias("labels"), F.coalesce("containment", F.lit(0.0)).alias("containment"))
