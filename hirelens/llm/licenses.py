"""License scans as an exact set-similarity join of text blocks (lines) with license templates.

A block matches a template when it holds at least ``threshold`` of the template's distinct
words.  Words are ordered by their frequency over the whole corpus, rarest first.  With
``need`` = ceil(threshold * size) words to find, a matching block holds one of the template's
first size - need + 1 words (prefix filter) and at least ``need`` template words (length
filter); the place of the shared word in both bounds what can still agree (positional
filter).  What passes is counted exactly.  Everything is DataFrame functions: only the
templates' own words and counts, which the caller bounds, come to the driver.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SEPARATOR = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = f"[^{SEPARATOR}]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
THRESHOLD = 0.8
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("cc-by", "Licensed under CC BY 4.0 Creative Commons Attribution International"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def phrase_pattern(phrase: str) -> str:
    """A phrase's words one after another, in ASCII case-blind form, with separators between and word borders around."""
    words = f"[{SEPARATOR}]+".join(f"(?i:{re.escape(w)})" for w in phrase.split())
    return f"(?<![^{SEPARATOR}]){words}(?![^{SEPARATOR}])"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def base_columns(text: Column, phrases: dict[str, str] = PHRASES) -> dict[str, Column]:
    """n_base, first_word, last_word and base_labels of a text (struct fields by name)."""
    text = F.coalesce(text, F.lit(""))
    hints = sorted({p.split()[-1] for p in phrases})
    maybe = text.rlike("(?i)" + "|".join(map(re.escape, hints)))
    count, first, last, labels = F.lit(0), [], [], []
    for phrase, label in phrases.items():
        pattern = phrase_pattern(phrase)
        n = F.regexp_count(text, F.lit(pattern)).cast("long")
        count = count + n
        before = F.split(text, pattern, 2)[0]
        until = F.regexp_extract(text, f"(?s)^(.*){pattern}", 1)
        first.append(F.when(n > 0, F.regexp_count(before, F.lit(WORD)).cast("long")))
        last.append(F.when(n > 0, F.regexp_count(until, F.lit(WORD)).cast("long")))
        labels.append(F.when(n > 0, F.lit(label)))
    none = F.lit(None).cast("long")
    return {"n_base": F.when(maybe, count).otherwise(F.lit(0)).cast("long"),
            "first_word": F.when(maybe, F.least(*first, none)), "last_word": F.when(maybe, F.greatest(*last, none)),
            "base_labels": F.when(maybe, F.array_compact(F.array(*labels))).otherwise(F.array().cast("array<string>"))}


def containment_matches(blocks: DataFrame, key: str, text: str, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, label, score): every block and template with containment >= threshold; score is the containment."""
    spark = blocks.sparkSession
    sets = [(label, sorted({w for w in re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", words.lower())}))
            for label, words in templates]
    vocabulary = sorted({w for _, words in sets for w in words})
    counted = (blocks.select(F.explode(words_of(F.col(text))).alias("w")).where(F.col("w").isin(vocabulary))
               .groupBy("w").agg(F.count("*").alias("n")))
    seen = {r["w"]: r["n"] for r in counted.collect()}  # at most the templates' own words
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    rows, prefix_words = [], set()
    for k, (label, words) in enumerate(sets):
        words = sorted(words, key=rank.get)
        need = math.ceil(threshold * len(words) - 1e-9)
        for place, w in enumerate(words[:len(words) - need + 1]):
            rows.append((w, k, label, words, len(words), need, place))
            prefix_words.add(w)
    prefixes = spark.createDataFrame(rows, "word string, template int, label string, words array<string>, size int, "
                                           "need int, place int")
    least = min(r[5] for r in rows)
    shared = F.array(*map(F.lit, sorted(prefix_words)))
    universe = F.array(*map(F.lit, order))
    found = (blocks.select(key, F.array_distinct(words_of(F.col(text))).alias("block"))
             .where(F.arrays_overlap("block", shared))  # prefix filter
             .withColumn("block", F.array_intersect(universe, F.col("block")))  # in the global order
             .where(F.size("block") >= least)  # length filter
             .select(key, "block", F.explode(F.array_intersect("block", shared)).alias("word")))
    joined = (found.join(F.broadcast(prefixes), "word")  # as many rows as the templates have prefix words
              .where(F.size("block") >= F.col("need"))
              .where(1 + F.least(F.col("size") - F.col("place") - 1,
                                 F.size("block") - F.array_position("block", F.col("word")))
                     + F.least(F.col("place"), F.array_position("block", F.col("word")) - 1) >= F.col("need")))  # positional filter
    overlap = F.size(F.array_intersect("block", "words"))
    return joined.withColumn("overlap", overlap).where("overlap >= need") \
        .select(key, "label", (F.col("overlap") / F.col("size")).alias("score"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD,
         phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Labels are sorted and comma-joined; score is the best containment of a template, 1 where a
    base phrase stands, else 0.  A null text is empty; repeated rows and equal texts get equal
    results; null ids stay; other columns are ignored; an empty table gives an empty result.
    Matches are found by text, not by id: equal texts are one key (its MD5).
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    blocks = own.where(F.length("t") > 0).select(F.md5("t").alias("key"), F.explode(F.split("t", "\n")).alias("block"))
    labels = (containment_matches(blocks, "key", "block", templates, threshold).groupBy("key")
              .agg(F.collect_set("label").alias("more"), F.max("score").alias("best")))
    labels = written(labels, "license-labels")  # joined as a table, so that AQE can split a text with very many copies
    base = own.select("id", F.md5("t").alias("own_key"), F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_words"),
                      *[c.alias(n) for n, c in base_columns(F.col("t"), phrases).items()])
    joined = base.join(labels, base["own_key"] == labels["key"], "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
                         F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
                         F.array_join(every, ",").alias("labels"), score.alias("score"))
