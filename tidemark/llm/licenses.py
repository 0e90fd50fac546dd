"""License scans by diagonal voting.

All rolling word k-gram hashes of a text are joined to the positions of those hashes in the
templates, a fixed set small enough to broadcast. A hit votes for the diagonal, its place in the
text less its place in the template. Short phrases need every k-gram of one diagonal; longer notices
merge neighbouring diagonals and need a share of their k-grams. Hits are verified on the words.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased.

Defined results: null, empty or wordless text has n_words 0, no places, empty labels and score 0;
overlapping places count each; rows equal in doc_id and text are scanned once and returned each;
documents with null doc_id are told apart by their text; an empty table gives no rows. Only doc_id
and text are read, so other columns do no harm.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Phrase to label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Words usual in notices of a license, in its label's name.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}
PHRASE_K, NOTICE_K = 2, 5
#: Diagonals at most this far apart are one place; the share of a notice's k-grams that it needs.
NEAR, SHARE = 3, 0.5
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def _positions(spark, texts: dict[str, str], k: int, name: str) -> DataFrame:
    """Of each k-gram of the templates: hash, words, template, position, k-grams of the template."""
    rows = []
    for text, label in texts.items():
        w = _words(text)
        rows += [(f"{name}:{' '.join(w)}", label, i, " ".join(w[i : i + k]), len(w) - k + 1) for i in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "template string, label string, tpos int, gram string, grams int")
    df = df.withColumn("h", F.xxhash64(*[F.get(F.split("gram", " "), F.lit(i)) for i in range(k)]))
    return F.broadcast(df.select(*[F.col(c).alias(f"{name}_{c}") for c in ("h", "template", "label", "tpos", "gram", "grams")]))


def _gram(k: int) -> list[Column]:
    return [F.get("words", F.col("pos") + i) for i in range(k)]


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    short = _positions(spark, PHRASES, PHRASE_K, "p")
    long = _positions(spark, {t: label for label, t in NOTICES.items()}, NOTICE_K, "n")
    words = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)).alias("words"))
    places = words.select("d", "t", "words", F.posexplode_outer("words").alias("pos", "word"))
    hashed = places.select("d", "t", "pos", "words", F.xxhash64(*_gram(PHRASE_K)).alias("h2"), F.xxhash64(*_gram(NOTICE_K)).alias("h5"))
    hits = hashed.join(short, F.col("h2") == F.col("p_h"), "left").join(long, F.col("h5") == F.col("n_h"), "left")
    same = lambda k, gram: F.coalesce(F.concat_ws(" ", *_gram(k)) == F.col(gram), F.lit(False))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    # a document's first row stays for its number of words, whatever it hits
    hits = hits.where(first | F.col("p_h").isNotNull() | F.col("n_h").isNotNull()).select(
        "d", "t", "pos", first.alias("first"), F.greatest(F.size("words"), F.lit(0)).cast("long").alias("n_words"),
        F.array(
            F.when(same(PHRASE_K, "p_gram"), F.struct(F.col("p_template").alias("template"), F.col("p_label").alias("label"), F.col("p_tpos").alias("tpos"), F.col("p_grams").alias("grams"), F.lit(True).alias("phrase"))),
            F.when(same(NOTICE_K, "n_gram"), F.struct(F.col("n_template").alias("template"), F.col("n_label").alias("label"), F.col("n_tpos").alias("tpos"), F.col("n_grams").alias("grams"), F.lit(False).alias("phrase"))),
            F.struct(F.lit("").alias("template"), F.lit("").alias("label"), F.lit(0).alias("tpos"), F.lit(0).alias("grams"), F.lit(False).alias("phrase")),
        ).alias("hs"),
    )
    votes = hits.select("d", "t", "pos", "first", "n_words", F.explode("hs").alias("x")).where("x is not null").select("d", "t", "first", "n_words", "x.*", (F.col("pos") - F.col("x.tpos")).alias("diagonal"))
    votes = votes.where("template <> '' or first")
    # one row of each template and diagonal; the row of template '' has the number of words and of equal rows
    on = votes.groupBy("d", "t", "template", "label", "phrase", "grams", F.when(F.col("template") != "", F.col("diagonal")).alias("diagonal")).agg(F.collect_set("tpos").alias("tposes"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("n"))
    # neighbouring diagonals of a notice in one place; a phrase's never merge
    order = "partition by d, t, template order by diagonal"
    on = on.withColumn("new", F.expr(f"if(phrase or template = '' or diagonal - lag(diagonal) over ({order}) <= {NEAR}, if(phrase, 1, 0), 1)"))
    on = on.withColumn("place", F.expr(f"sum(new) over ({order})"))
    at = on.groupBy("d", "t", "template", "label", "phrase", "grams", "place").agg(F.size(F.array_distinct(F.flatten(F.collect_list("tposes")))).alias("votes"), F.min("diagonal").cast("long").alias("start"), F.max("n_words").alias("n_words"), F.max("n").alias("n"))
    base = "phrase and votes = grams"
    good = f"({base}) or (template <> '' and not phrase and votes >= {SHARE} * grams)"
    out = at.groupBy("d", "t").agg(
        F.expr("max(n_words) filter (where template = '')").alias("n_words"),
        F.expr("max(n) filter (where template = '')").alias("__rows"),
        F.expr(f"count_if({base})").alias("n_base"),
        F.expr(f"min(start) filter (where {base})").alias("first_word"),
        F.expr(f"max(start) filter (where {base})").alias("last_word"),
        F.expr(f"array_join(array_sort(collect_set(label) filter (where {base})), ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(collect_set(label) filter (where {good})), ',')").alias("labels"),
        F.expr(f"coalesce(max(if({good}, votes / grams, 0)), 0)").cast("double").alias("score"),
    )
    return out.select("d", F.explode(F.sequence(F.lit(1), F.col("__rows").cast("int"))), *[c for c in out.columns if c not in ("d", "t", "__rows")]).drop("col").withColumnRenamed("d", "doc_id")
