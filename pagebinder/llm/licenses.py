"""License scans: diagonal voting of word k-grams, in DataFrame operations only.

Every text's rolling k-gram hashes are joined with the places of the same k-grams in license templates. A text that quotes a
template has many hits on one diagonal (its place less the template's place), so hits are counted by diagonal;
neighbouring diagonals, which inserted or missing words part, are merged. Spans are verified: words are compared, not hashes
only, and a span counts if the distinct template words that stand in it are enough of the template. Beside that stand plain phrases (`PHRASES`), found wherever their words stand one after the other.

The templates are a fixed list, far below a broadcast's bound (`BROADCAST_GRAMS`); a longer list is joined by a shuffle. Texts are not
shuffled: after the join a text has one row and one for each hit.

Defined results: null texts count as empty, with no words and labels; repeated rows get repeated results. score: 1 with a
phrase; otherwise of the spans that count the largest part of a template that stands there unbroken (its distinct k-grams and k - 1,
by its words, so breaks lower it, though not the covered part); 0 with neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM_GAP, ascii_lower

K = 3
#: Diagonals so far apart are still one span.
GAP = 3
#: Part of a template's words that a span must cover.
COVER = 0.7
BROADCAST_GRAMS = 1_000_000

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of common license notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "licensed under cc by sa 4 0"),
    ("cc", "licensed under cc by 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("cc", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    """h, tid, tpos, label, t_words, t_gram (the words)."""
    rows = [(t, label, text) for t, (label, text) in enumerate(templates)]
    words = spark.createDataFrame(rows, "tid int, label string, text string").withColumn("w", F.split("text", " "))
    return words.select("tid", "label", F.size("w").alias("t_words"), F.posexplode(_grams(F.col("w"), k)).alias("tpos", "t_gram")).withColumn("h", F.xxhash64("t_gram"))


def _grams(words: Column, k: int) -> Column:
    n = F.size(words) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(words, i, k))).otherwise(F.array().cast("array<array<string>>"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = K, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base (places of phrases), first_word, last_word, base_labels, labels, score, spans (of
    templates: label, first word and end in the text, covered part, score)."""
    spark = docs.sparkSession
    low = docs.select(F.col(doc_id).alias("doc_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    words = low.select("doc_id", F.monotonically_increasing_id().alias("row"), F.array_remove(F.split("low", ALNUM_GAP), "").alias("w"), *[F.contains("low", F.lit(p.split()[-1])).alias(f"may{i}") for i, p in enumerate(phrases)])
    none = F.array().cast("array<int>")

    def places(i: int, phrase: str) -> Column:
        parts = phrase.split()
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w"), F.lit(1)) - 1), lambda j: _all([F.coalesce(F.get("w", j + x) == p, F.lit(False)) for x, p in enumerate(parts)]))
        return F.when(F.col(f"may{i}"), at).otherwise(none)

    found = words.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), *[places(i, p).alias(f"at{i}") for i, p in enumerate(phrases)], _grams(F.col("w"), k).alias("grams"))
    all_ = F.flatten(F.array(*[F.col(f"at{i}") for i in range(len(phrases))]))
    labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(x)) for i, x in enumerate(phrases.values())]), lambda x: x.isNotNull())))
    keys = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
    base = found.select("row", "doc_id", "n_words", F.size(all_).cast("long").alias("n_base"), F.array_min(all_).cast("long").alias("first_word"), F.array_max(all_).cast("long").alias("last_word"), F.array_join(labels, ",").alias("base"), F.posexplode_outer("grams").alias("pos", "gram")).withColumn("h", F.xxhash64("gram"))
    of = template_grams(spark, templates, k)
    if sum(len(t.split()) for _, t in templates) <= BROADCAST_GRAMS:
        of = F.broadcast(of)
    hits = base.join(of, (base["h"] == of["h"]) & (F.col("gram") == F.col("t_gram")), "left").where("tid is not null or pos is null or pos = 0")
    # votes of diagonals, each template place once
    votes = hits.groupBy(*keys, "tid", "label", "t_words", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy("row", "tid").orderBy("diagonal")
    islands = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    # of an island the template's places, as many as the template has at most, however often they occur
    spans = islands.groupBy(*keys, "tid", "label", "t_words", "island").agg(F.array_sort(F.collect_set("tpos")).alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
    # a gram covers k words of the template from its place on
    places_ = F.array_distinct(F.flatten(F.transform("votes", lambda p: F.sequence(p, p + (k - 1)))))
    covered = F.size(places_) / F.col("t_words")
    unbroken = (F.size("votes") + k - 1) / F.col("t_words")
    spans = spans.withColumn("span", F.when(F.col("tid").isNotNull() & (covered >= cover), F.struct("label", "first", (F.col("last") + k).alias("end"), covered.alias("covered"), unbroken.alias("score"))))
    out = spans.groupBy(*keys).agg(F.array_sort(F.collect_list("span")).alias("spans"))
    all_labels = F.array_sort(F.array_distinct(F.concat(F.filter(F.split("base", ","), lambda x: x != ""), F.transform("spans", lambda s: s["label"]))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.col("base").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), score.alias("score"), "spans")


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out
