"""License scans by diagonal voting.

Texts and license templates become words. All rolling windows of k words of every text are joined, by their
hashes, to the templates' (a table of fixed size, given by the caller, checked against `max_template_words` before it is
broadcast). A match of text place i and template place j lies on diagonal i - j. Votes are summed by
diagonal; in one text and template, neighbouring diagonals at most `max_gap` apart are merged (words were left
out or put in); each merged span is then verified place by place, on matches of the words themselves: the
share of the template's words that stand there, in the template's order, is its score.

Everything is joins, windows and aggregates on matches, of which ordinary texts have none.

Defined cases: a null or empty text has no words, label '' and score 0; repeated rows get the same result
each; of overlapping spans the best score stays, ties included; an empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ascii_lower, shared_table

#: What separates words, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 3

#: Phrases that label a text wherever their words stand consecutively.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Public license notices, as published.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2": "This work is licensed under the GNU General Public License, version 2",
    "lgpl": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0": "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "proprietary": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission",
}


def words(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP, -1), lambda w: w != "")


def grams(w: Column, k: int) -> Column:
    """All windows of k words, by their first word's place."""
    return F.when(F.size(w) < k, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.concat_ws(" ", *[F.element_at(w, (i + d).cast("int")) for d in range(k)])))


def template_table(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str], k: int, max_template_words: int) -> DataFrame:
    """(template, label, base, length, t_place, t_gram, t_hash), a row for each place of each template."""
    rows = [(f"phrase:{n}", n, True, t) for n, t in phrases.items()] + [(f"text:{n}", n, False, t) for n, t in templates.items()]
    if sum(len(t.split()) for *_, t in rows) > max_template_words:
        raise ValueError(f"templates of more than {max_template_words} words would not be small enough to broadcast")
    t = spark.createDataFrame(rows, "template string, label string, base boolean, text string").withColumn("tokens", words(F.col("text")))
    t = t.select("template", "label", "base", F.size("tokens").alias("length"), F.posexplode(grams(F.col("tokens"), k)).alias("t_place", "t_gram"))
    return t.withColumn("t_hash", F.xxhash64("t_gram"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
         k: int = GRAM, max_gap: int = 4, min_score: float = 0.6, max_template_words: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). Documents: doc, k1, k2, n_words, one row per row of `df`; spans: k1, k2, template,
    label, base, first (place of the span's first word), last (of its last), score. (k1, k2), a hash of id
    and text, joins the two; it is the same for repeated rows."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = df.select(F.col(id_col).alias("doc"), text.alias("text"))
    worded = doc.select("doc", F.xxhash64("doc", "text").alias("k1"), F.xxhash64(F.lit("second"), "text", "doc").alias("k2"), words(F.col("text")).alias("words"))
    table = template_table(spark, phrases, templates, k, max_template_words)
    # Place 0 is no gram: it carries the text's number of words. Gram n stands at place n, its first word at n - 1.
    every = worded.select("doc", "k1", "k2", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), grams(F.col("words"), k))).alias("n", "gram"))
    every = every.withColumn("hash", F.when(F.col("n") > 0, F.xxhash64("gram")))
    # The hash finds the template's places; the words themselves are compared with it.
    hits = every.join(F.broadcast(table), (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left")
    hits = hits.filter((F.col("n") == 0) | F.col("template").isNotNull()).withColumn("place", (F.col("n") - 1).cast("long"))
    hits = shared_table(hits.select("doc", "k1", "k2", "n_words", "place", "template", "label", "base", "length", "t_place"), "license-hits")
    by = ["k1", "k2", "template"]
    # Votes by diagonal; repeated rows vote once, as the same text.
    vote = hits.filter("place >= 0").groupBy(*by, "label", "base", "length", "place", "t_place").agg(F.lit(1).alias("one")).withColumn("diagonal", F.col("place") - F.col("t_place"))
    diagonals = vote.groupBy(*by, "label", "base", "length", "diagonal").agg(F.count("*").alias("votes"), F.min("place").alias("first"), (F.max("place") + (k - 1)).alias("last"))
    whole = diagonals.filter(F.col("base") & (F.col("votes") == F.col("length") - (k - 1))).select(*by, "label", "base", F.col("diagonal").alias("first"), "last", F.lit(1.0).alias("score"))
    # Neighbouring diagonals make one span: with words left out or put in, one copy of a template votes for several.
    order = Window.partitionBy(*by).orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > max_gap
    spans = diagonals.filter(~F.col("base")).withColumn("span", F.sum(F.when(far, 1).otherwise(0)).over(order))
    # Verified by place: a vote adds those of its k template words that lie beyond what the span has covered.
    placed = vote.filter(~F.col("base")).join(spans.select(*by, "diagonal", "span"), [*by, "diagonal"])
    seen = Window.partitionBy(*by, "span").orderBy("place", "t_place").rowsBetween(Window.unboundedPreceding, -1)
    new = F.least(F.lit(k), F.greatest(F.lit(0), F.col("t_place") + k - F.coalesce(F.max(F.col("t_place") + k).over(seen), F.lit(0))))
    merged = placed.withColumn("new", new).groupBy(*by, "label", "base", "length", "span").agg(F.min("place").alias("first"), (F.max("place") + (k - 1)).alias("last"), (F.sum("new") / F.col("length")).alias("score"))
    merged = merged.filter(F.col("score") >= min_score).select(*by, "label", "base", "first", "last", "score")
    # Templates that share wording match the same words: of spans that overlap, the best stay, ties included.
    text_order = Window.partitionBy("k1", "k2").orderBy("first", "last")
    apart = F.coalesce(F.col("first") > F.max("last").over(text_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    merged = merged.withColumn("apart", apart.cast("int")).withColumn("cluster", F.sum("apart").over(text_order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max("score").over(Window.partitionBy("k1", "k2", "cluster"))
    merged = merged.withColumn("best", best).filter("score = best").select(*by, "label", "base", "first", "last", "score")
    return hits.filter("place < 0").select("doc", "k1", "k2", "n_words"), whole.unionByName(merged)


def label(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document: n_base, first_word, last_word, base_labels, labels, score and n_spans."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  there are as many as templates at most
    base = F.col("base")
    found = spans.groupBy("k1", "k2").agg(F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
                                          names(F.when(base, F.col("label"))).alias("base_labels"), names("label").alias("labels"), F.max("score").alias("score"), F.count("*").alias("n_spans"))
    found = shared_table(found, "license-labels")
    return docs.join(found, ["k1", "k2"], "left").fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0, "n_spans": 0}).drop("k1", "k2")
