"""License scans by diagonal voting (operator 2), in DataFrame functions only.

Every word 3-gram of every text is joined, by hash, to the 3-grams of the
license templates.  A hit votes for its diagonal, the text position less the
template position; votes are kept as bit masks over blocks of 64 template
3-grams, so a template may be a whole license and repeated rows change
nothing.  A short phrase stands where its diagonal has all votes.  For the
longer templates neighbouring diagonals (words put in or left out) are merged,
and a merged span is verified: enough of the template's 3-grams, in not much
more room than the template takes.

Base phrases and labels, and the method's own templates, are the two tables
below; ``scan`` takes other templates, of any length and number.  ``score`` is
the best share of a template's 3-grams found.

Defined results: a null or empty text has no words and no labels; a text's
rows are told apart by doc_id and text hash, so rows with null or repeated
doc_ids and repeated rows each get their own text's result; a text of any
length is read whole; extra columns are ignored; an empty table gives an empty
table; a template of fewer than three words is never found.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopflow.llm.common import read_table

K = 3
BLOCK = 64  # template 3-grams to a mask
BROADCAST_GRAMS = 100_000  # about 10 MB; more template 3-grams are joined by a shuffle
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels of the base.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Templates of the method, words of public licenses.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                 "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]

NEAR = 3            # words between diagonals that are merged
LEAST_SHARE = 0.6   # of a template's 3-grams
MOST_ROOM = 1.5     # times the template's words


def words(text: Column) -> Column:
    """Lower-case words of a text; null texts have none.

    ``lower`` maps no character across the word boundary class and changes
    A-Z like the contract asks; other letters never occur in a template.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def template_grams(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(hash, g0, g1, g2, template, label, base, at, size): one row per 3-gram of a
    template, broadcast where they are few."""
    rows = []
    for number, (label, phrase, base) in enumerate([(*b, True) for b in BASE] + [(*t, False) for t in templates]):
        w = [x for x in re.split(BREAK, phrase.lower()) if x]
        rows += [(*w[i:i + K], number, label, base, i, len(w)) for i in range(len(w) - K + 1)]
    grams = spark.createDataFrame(rows, "g0 string, g1 string, g2 string, template int, label string, base boolean, at int, size int")
    grams = grams.withColumn("hash", F.xxhash64("g0", "g1", "g2"))
    return F.broadcast(grams) if len(rows) <= BROADCAST_GRAMS else grams


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), words(F.col(text)).alias("w"))


def votes(docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, text_hash, template, label, base, size, diagonal, block, mask, first, last):
    the template 3-grams found on each diagonal, a mask per block of them, and
    the text positions they span."""
    grams = F.arrays_zip("w", F.slice("w", F.lit(2), F.size("w")).alias("w1"), F.slice("w", F.lit(3), F.size("w")).alias("w2"))
    places = (_keyed(docs, text).where(F.size("w") >= K)
              .select("doc_id", "text_hash", F.posexplode(grams).alias("position", "g"))
              .select("doc_id", "text_hash", "position", F.col("g.w").alias("a"), F.col("g.w1").alias("b"), F.col("g.w2").alias("c"))
              .withColumn("hash", F.xxhash64("a", "b", "c")))
    hits = places.join(template_grams(docs.sparkSession, templates), "hash").where("a = g0 and b = g1 and c = g2")
    return (hits.groupBy("doc_id", "text_hash", "template", "label", "base", "size",
                         (F.col("position") - F.col("at")).alias("diagonal"), F.expr(f"at div {BLOCK}").alias("block"))
                .agg(F.bit_or(F.expr(f"shiftleft(bigint(1), at % {BLOCK})")).alias("mask"),
                     F.min("position").alias("first"), (F.max("position") + K - 1).alias("last")))


def spans(voted: DataFrame) -> DataFrame:
    """Verified spans.  A base phrase has all its 3-grams on one diagonal, where it
    starts (``at``); other templates merge neighbouring diagonals and need
    enough of their 3-grams."""
    key = ["doc_id", "text_hash", "template"]
    about = [*key, "label", "base", "size", "span"]
    order = Window.partitionBy(*key).orderBy("diagonal")
    # Blocks of one diagonal follow each other at distance 0.
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("base"), 0).otherwise(NEAR)
    merged = (voted.withColumn("new", F.when(~apart, 0).otherwise(1))
                   .withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
                   .groupBy(*about, "block")
                   .agg(F.bit_or("mask").alias("mask"), F.min("first").alias("first"), F.max("last").alias("last"))
                   .groupBy(*about)
                   .agg((F.sum(F.bit_count("mask")) / (F.col("size") - K + 1)).alias("share"), F.min("first").alias("first"), F.max("last").alias("last")))
    close = F.col("last") - F.col("first") + 1 <= MOST_ROOM * F.col("size") + NEAR
    return (merged.where(F.when(F.col("base"), F.col("share") == 1).otherwise((F.col("share") >= LEAST_SHARE) & close))
                  .withColumn("at", F.when(F.col("base"), F.col("first"))))


def scan(docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """A row per document: words, base places and labels, all labels, score.
    ``templates`` are (label, text) pairs, up to whole licenses."""
    found = (spans(votes(docs, text, templates)).groupBy("doc_id", "text_hash")
             .agg(F.count_if("base").alias("n_base"), F.min("at").alias("first_word"), F.max("at").alias("last_word"),
                  F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("b"),
                  F.sort_array(F.collect_set("label")).alias("l"), F.max("share").alias("score")))
    rows = _keyed(docs, text).select("doc_id", "text_hash", F.size("w").cast("bigint").alias("n_words"))
    right = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    joined = rows.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"), F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce(F.array_join("b", ","), F.lit("")).alias("base_labels"), F.coalesce(F.array_join("l", ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: license places and labels of all documents."""
    return scan(read_table(spark, sf_dir, "documents"))
