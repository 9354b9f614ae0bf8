"""License texts inside documents: k-gram hashes joined to template positions, voted by diagonal, merged, verified.

Words are the matches of ``WORD`` in the text after lower-casing A-Z. A template shorter than ``LONG`` words is cut in
grams of ``min(2, its words)`` words, a longer one in grams of four. Every document position meets every template
position whose gram has the same hash and the same words; the difference of the two positions is the diagonal, and the
grams that meet on it are its votes. A diagonal counts when it holds a quarter of the template's grams. Diagonals of one
template that lie no more than ``slack`` apart are one copy with words put in or left out: ``slack`` is the number of
words that may be lacking, so that a template of two or three words is found only whole, each place on its own. A copy is
verified when its votes cover at least ``share`` hundredths of the template's words.

SQL functions only. One pass reads the texts; each word probes one broadcast table per gram width (templates are an
argument, their grams are counted before they are broadcast). What leaves the pass is one row per document and one per
hit; a document's hits meet under a number of its row, so no key is shared by documents.

Edge cases: a null text counts as empty and has no words; rows without a copy have counts of 0, empty labels, null places
and a score of 0. Repeated rows and rows that share a doc_id are judged one by one; a null doc_id stays null. Templates
without words match nothing. A very long text is one row of words and as many positions. Of a span found by several
templates each label counts. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostguard.llm.common import lower_ascii, small
from hostguard.session import Scratch

# What separates words (of the lower-cased text), and the phrases whose places are counted.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]

# Opening sentences of public license texts and notices.
TEMPLATES = [
    ("spdx", "SPDX-License-Identifier"),
    ("mit", "Released under the MIT License"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("as-is", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
]

LONG, SHORT_GRAM, LONG_GRAM = 8, 2, 4
SHARE = 80  # hundredths
VOTES = 4  # a diagonal holds at least one in so many of the template's grams


def words(text: Column) -> Column:
    """The words of the lower-cased text, split once; an empty first or last piece is cut off."""
    cut = F.split(lower_ascii(text), NO_WORD)
    first = F.when(F.get(cut, F.lit(0)) == "", 2).otherwise(1)
    last = F.when(F.get(cut, F.size(cut) - 1) == "", F.size(cut) - 1).otherwise(F.size(cut))
    return F.slice(cut, first, F.greatest(last - first + 1, F.lit(0)))


def gram(place: Column, width: int) -> Column:
    """``width`` words from ``place`` on; fewer at the end of a text, which equal no gram of that width."""
    return F.concat_ws(" ", *[F.get("words", place + k) for k in range(width)])


def template_table(spark: SparkSession, templates: list[tuple[str, str]], n_base: int) -> DataFrame:
    """(template, label, base, words, width, slack, grams): one row per template that has words."""
    named = [
        F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(i < n_base).alias("base"), F.lit(text).alias("text"))
        for i, (label, text) in enumerate(templates)
    ]
    cut = spark.range(1).select(F.inline(F.array(*named))).withColumn("words", words(F.col("text"))).drop("text")
    size = F.size("words")
    width = F.when(size >= LONG, LONG_GRAM).otherwise(F.least(size, F.lit(SHORT_GRAM)))
    lacking = F.floor(size * (100 - SHARE) / 100).cast("int")
    return cut.filter(size > 0).withColumns({"width": width, "slack": lacking, "grams": size - width + 1})


def template_grams(templates: DataFrame, width: int) -> DataFrame:
    """(hash, places): the template positions of every gram of ``width`` words, with the gram itself."""
    at = templates.filter(F.col("width") == width).select("template", "words", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("t"))
    rows = at.select("template", "t", gram(F.col("t"), width).alias("gram"))
    return rows.groupBy(F.xxhash64("gram").alias(f"hash{width}")).agg(F.collect_list(F.struct("template", "t", "gram")).alias(f"places{width}"))


def same_words(width: int) -> Column:
    return F.filter(f"places{width}", lambda place: place["gram"] == gram(F.col("i"), width))


def hits(docs: DataFrame, templates: DataFrame, widths: list[int]) -> DataFrame:
    """(row, doc_id, n_words, i, found): word i meets the template places ``found``; i = -1 stands for the document."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), words(F.col("text")).alias("words"))
    at = numbered.select("*", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("i"))
    for width in widths:
        probe = F.xxhash64(gram(F.col("i"), width)) == F.col(f"hash{width}")
        at = at.join(small(template_grams(templates, width)), probe, "left")
    none = F.array().cast("array<struct<template:int,t:int,gram:string>>")
    met = [F.when(F.col(f"places{w}").isNull(), none).otherwise(same_words(w)) for w in widths]
    some = reduce(lambda a, b: a | b, [F.col(f"places{w}").isNotNull() for w in widths], F.col("i") < 0)
    found = F.concat(*met) if met else none
    return at.filter(some).select("row", "doc_id", F.size("words").cast("bigint").alias("n_words"), "i", found.alias("found"))


def spans(met: DataFrame, templates: DataFrame) -> DataFrame:
    """(row, template, label, base, start, end, share): the verified copies, words from ``start`` to ``end`` inclusive."""
    facts = F.broadcast(templates.select("template", "label", "base", "width", "slack", "grams", F.size("words").alias("size")))
    votes = met.filter("i >= 0").select("row", "i", F.inline("found")).withColumn("diagonal", F.col("i") - F.col("t"))
    voted = votes.groupBy("row", "template", "diagonal").agg(F.sort_array(F.collect_set("t")).alias("places"))
    voted = voted.join(facts, "template").filter(F.size("places") * VOTES >= F.col("grams"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack")
    merged = voted.withColumn("copy", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(along))
    covered = F.explode(F.array_distinct(F.flatten(F.transform("places", lambda t: F.sequence(t, t + F.col("width") - 1)))))
    each = merged.select("row", "template", "label", "base", "copy", "size", "diagonal", covered.alias("word"))
    copies = each.groupBy("row", "template", "label", "base", "copy", "size").agg(
        F.count_distinct("word").alias("covered"),
        F.min(F.col("diagonal") + F.col("word")).alias("start"),
        F.max(F.col("diagonal") + F.col("word")).alias("end"),
    )
    found = copies.filter(F.col("covered") * 100 >= F.col("size") * SHARE)
    return found.select("row", "template", "label", "base", "start", "end", (F.col("covered") / F.col("size")).alias("share"))


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: list[tuple[str, str]] = BASE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one row per document.

    ``spans`` lists (start, end, label, share) in order. ``base`` phrases are templates too, counted place by place.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = scratch.keep(template_table(spark, [*base, *templates], len(base)).coalesce(1))
    widths = [w for w in (1, SHORT_GRAM, LONG_GRAM) if not known.filter(F.col("width") == w).isEmpty()]
    met = scratch.keep(hits(docs, known, widths))
    start = F.when(F.col("base"), F.col("start"))
    found = spans(met, known).groupBy("row").agg(
        F.count(start).alias("n_base"),
        F.min(start).cast("bigint").alias("first_word"),
        F.max(start).cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "end", "label", "share"))).alias("spans"),
    )
    found = scratch.keep(found)
    whole = met.filter("i < 0").select("row", "doc_id", "n_words").join(small(found), "row", "left").drop("row")
    return whole.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})
