"""License scan: an exact set-similarity join of text blocks with notice templates.

Tokens are ordered by their frequency over all documents, rarest first. A block
can hold a share t of a template only if it shares one of the template's first
n - ceil(t n) + 1 tokens (prefix filter), has enough tokens itself (length
filter) and leaves enough tokens behind the shared one on both sides (positional
filter). What passes is verified. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from plantgauge.llm.common import stored, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases that label a text wherever their words stand together.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices by label; the scan finds blocks that hold most of one's distinct words.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
]
# share of a template's distinct words a block must hold
THRESHOLD = 0.9


def tokens(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({WORD})"), 1)


def needed(size: int, threshold: float) -> int:
    """Shared tokens that make up the threshold."""
    return math.ceil(size * threshold - 1e-9)


def template_tokens(templates) -> list[tuple[int, str, list[str]]]:
    """(id, label, distinct tokens) of each template."""
    import re

    return [(i, label, sorted(set(re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))))) for i, (label, text) in enumerate(templates)]


def token_counts(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Times each word of ``vocabulary`` stands in all texts; as many rows as words."""
    held = F.filter(tokens(F.col("_l_text")), lambda w: w.isin(vocabulary))
    rows = texts.select(F.explode(held).alias("w")).groupBy("w").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in rows}


def phrase_places(words: Column, phrase: str) -> Column:
    """Word positions at which the phrase starts."""
    parts = phrase.split()

    def here(w, i):
        found = w == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found = found & F.coalesce(F.get(words, i + k) == part, F.lit(False))
        return found

    marked = F.transform(words, lambda w, i: F.when(here(w, i), i))
    return F.filter(marked, lambda p: p.isNotNull())


def license_scan(df: DataFrame, text: str = "text", key: str = "doc_id", templates=None, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``df``'s key with its license figures, and the matching blocks.

    Documents: key, n_words, n_base, first_word, last_word (long), base_labels,
    labels (string), score (double: the best containment, 1 where a base phrase
    stands, else 0). Blocks: key, block (string), label, template (int),
    containment. A block is a line, or a paragraph of several lines. A null text
    is empty, rows with a null key keep their own result, repeated rows get equal
    results, an empty table gives none. Templates are few by nature (a parameter);
    nothing else is gathered on the driver than one count per template word.
    """
    known = template_tokens(TEMPLATES if templates is None else templates)
    vocabulary = sorted({w for _, _, ws in known for w in ws})
    docs = df.select(F.col(key), whole_text(text).alias("_l_text"))
    counts = token_counts(docs, vocabulary)
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts[w], w)))}

    low = lambda words: f"(?i)(?<![a-z0-9])({'|'.join(words)})(?![a-z0-9])"
    index, heads = [], set()
    for i, label, ws in known:
        ws = sorted(ws, key=order.get)
        least = needed(len(ws), threshold)
        for at, w in enumerate(ws[: len(ws) - least + 1]):
            index.append((order[w], i, label, at, least, [order[x] for x in ws]))
            heads.add(w)
    spark = df.sparkSession
    prefixes = spark.createDataFrame(index or [(-1, -1, "", 0, 1, [0])], "rank int, template int, label string, at int, least int, whole array<int>")
    ranks = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, order[w])]) if vocabulary else F.create_map()

    kept = [F.col(key), F.xxhash64("_l_text").alias("_l_h"), F.length("_l_text").alias("_l_n")]
    lines = F.split("_l_text", "\n")
    paragraphs = F.filter(F.split("_l_text", r"\n[\x20\x09\r]*\n"), lambda p: p.contains("\n"))
    blocks = (
        docs.where(F.col("_l_text").rlike(low(sorted(heads))) if heads else F.lit(False))
        .select(*kept, F.explode(F.array_distinct(F.concat(lines, paragraphs))).alias("block"))
        .where(F.col("block").rlike(low(sorted(heads))) if heads else F.lit(False))
        .withColumn("_l_b", F.array_distinct(F.filter(tokens(F.col("block")), lambda w: w.isin(vocabulary))))
        .withColumn("_l_b", F.sort_array(F.transform("_l_b", lambda w: F.element_at(ranks, w))))
    )
    size = F.size("_l_b")
    pairs = (
        blocks.select("*", F.posexplode("_l_b").alias("_l_at", "rank"))
        .join(F.broadcast(prefixes), "rank")  # some rows per template, a parameter
        .where((size >= F.col("least")) & (1 + F.least(F.size("whole") - F.col("at") - 1, size - F.col("_l_at") - 1) >= F.col("least")))
        .withColumn("_l_both", F.size(F.array_intersect("_l_b", "whole")))
        .where(F.col("_l_both") >= F.col("least"))
        .select(key, "_l_h", "_l_n", "block", "label", "template", (F.col("_l_both") / F.size("whole")).alias("containment"))
        .distinct()
    )
    pairs = stored(pairs, "licenses")

    found = docs.select(*kept, "_l_text", F.regexp_count("_l_text", F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"))
    found = found.withColumn("_l_w", F.when(F.col("_l_text").rlike(f"(?i){'|'.join(sorted({p.split()[-1] for p in PHRASES}))}"), tokens(F.col("_l_text")))).drop("_l_text")
    names = sorted(PHRASES)
    found = found.select("*", *[phrase_places(F.col("_l_w"), p).alias(f"_l_p{i}") for i, p in enumerate(names)]).drop("_l_w")
    every = [F.coalesce(F.col(f"_l_p{i}"), F.array().cast("array<int>")) for i in range(len(names))]
    base = F.concat(*[F.when(F.size(e) > 0, F.array(F.lit(PHRASES[p]))).otherwise(F.array().cast("array<string>")) for e, p in zip(every, names)])
    found = found.select(
        key, "_l_h", "_l_n", "n_words",
        sum(F.size(e) for e in every).cast("long").alias("n_base"),
        F.array_min(F.concat(*every)).cast("long").alias("first_word"),
        F.array_max(F.concat(*every)).cast("long").alias("last_word"),
        base.alias("_l_base"),
    )
    by_doc = pairs.groupBy(F.col(key).alias("_l_k"), F.col("_l_h").alias("_l_h2"), F.col("_l_n").alias("_l_n2")).agg(
        F.collect_set("label").alias("_l_more"), F.max("containment").alias("_l_best")
    )
    joined = found.join(
        by_doc, F.col(key).eqNullSafe(F.col("_l_k")) & (F.col("_l_h") == F.col("_l_h2")) & (F.col("_l_n") == F.col("_l_n2")), "left"
    )
    text_of = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    documents = joined.select(
        key, "n_words", "n_base", "first_word", "last_word",
        text_of(F.col("_l_base")).alias("base_labels"),
        text_of(F.concat("_l_base", F.coalesce("_l_more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_l_best", F.lit(0.0))).alias("score"),
    )
    return documents, pairs.drop("_l_h", "_l_n")
