"""License scans by diagonal voting, in DataFrame operations alone.

Words are runs of letters, digits and anything beyond ASCII, with A-Z lower-cased. Every run of
``K`` words of every text is hashed and joined to the same hashes of the templates; a hit of text
position p and template position q votes for the diagonal p - q. Neighbouring diagonals of one
template merge (a word put in or left out shifts the rest by one), and a merged span is verified:
its words are compared with the template's themselves, not their hashes, and the share of the
template's k-grams found in it is its score. A template's label is added at ``MIN_SCORE`` or more.

Besides, the ``PHRASES`` are found wherever their words stand consecutively; their labels always stay.
A document's score is its best span's, and at least ``PHRASE_SCORE`` if a phrase was found.

The corpus is cut into words once; what hits a template or a phrase is written, with a row for each
document, and all else works on that small table. Templates are a parameter: whole license texts serve
as well as notices. Their grams are broadcast up to ``BROADCAST_GRAMS`` and joined by a shuffle beyond;
templates of fewer than ``K`` words are looked up as they stand, like phrases.

Null texts count as empty: no words, no labels, score 0. Very long texts are rows of words like
others. Repeated rows get the same result each, also with null doc_ids; empty tables give empty
results; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty

K = 4
#: Diagonals at most this far apart merge, and so do hits on them with at most GAP words between.
SHIFT, GAP = 3, 40
MIN_SCORE = 0.6
#: Templates with more k-grams are joined by a shuffle.
BROADCAST_GRAMS = 100_000
PHRASE_SCORE = 0.5

#: The phrases that are found as they stand, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Openings and notices of public licenses.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; lower() would fold letters beyond ASCII too."""
    plain = F.when(F.regexp_like(text, F.lit(r"[^\x00-\x7F]")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(plain, F.lit(WORDS), F.lit(0))


def template_words(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    lower = str.maketrans(UPPER, LOWER)
    return [(label, re.findall(WORDS, text.translate(lower))) for label, text in templates]


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """``gram, t_words, template, label, t_pos, t_grams`` for each k words of each template."""
    rows = [(words[q : q + k], i, label, q, len(words) - k + 1) for i, (label, words) in enumerate(template_words(templates)) for q in range(len(words) - k + 1)]
    grams = spark.createDataFrame(rows, "t_words array<string>, template int, label string, t_pos int, t_grams int").withColumn("gram", F.xxhash64(*(F.col("t_words")[i] for i in range(k))))
    return F.broadcast(grams) if len(rows) <= BROADCAST_GRAMS else grams.hint("merge")


def _positions(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, text_hash, n_words, pos, w0 .. w<k-1>``: each word with the k - 1 after it, null beyond the end; at -1 a row for the document."""
    words = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), words_of(text_or_empty()).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    shifted = [F.col("words")] + [F.slice("words", i + 1, F.greatest(F.size("words") - i, F.lit(0))) for i in range(1, k)]
    zipped = F.arrays_zip(*(c.alias(f"w{i}") for i, c in enumerate(shifted)))
    whole = F.array(F.struct(*(F.lit(None).cast("string").alias(f"w{i}") for i in range(k))))
    rows = words.select("doc_id", "text_hash", "n_words", F.posexplode(F.concat(whole, zipped)).alias("pos", "w"))
    return rows.select("doc_id", "text_hash", "n_words", (F.col("pos") - 1).alias("pos"), *(F.col("w").getField(f"w{i}").alias(f"w{i}") for i in range(k)))


def _standing(phrases) -> Column:
    """The label of the phrase that begins at a row, given as labels and words."""
    found = F.lit(None).cast("string")
    for label, words in phrases:
        here = F.col("w0") == words[0]
        for i, w in enumerate(words[1:], 1):
            here &= F.col(f"w{i}") == w
        found = F.when(here, label).otherwise(found)
    return found


def hits(docs: DataFrame, *, templates=TEMPLATES, phrases=PHRASES, k: int = K) -> DataFrame:
    """``doc_id, text_hash, n_words, pos, phrase, short, template, label, t_pos, t_grams``: what stands where, and a row of pos -1 for each row of ``docs``."""
    at = _positions(docs, max(k, *(len(p.split(" ")) for p, _ in phrases)))
    short = [(label, words) for label, words in template_words(templates) if 0 < len(words) < k]
    at = at.withColumns({"phrase": _standing([(label, p.split(" ")) for p, label in phrases]), "short": _standing(short)})
    at = at.withColumn("gram", F.when(F.col(f"w{k - 1}").isNotNull(), F.xxhash64(*(f"w{i}" for i in range(k)))))
    met = at.join(template_grams(docs.sparkSession, templates, k), "gram", "left")
    same = F.coalesce(F.array(*(f"w{i}" for i in range(k))) == F.col("t_words"), F.lit(False))
    met = met.where(F.col("phrase").isNotNull() | F.col("short").isNotNull() | (F.col("pos") < 0) | same)
    return met.select("doc_id", "text_hash", "n_words", "pos", "phrase", "short", *(F.when(same, F.col(c)).alias(c) for c in ("template", "label", "t_pos", "t_grams")))


def spans(found: DataFrame, k: int = K) -> DataFrame:
    """``doc_id, text_hash, template, label, first_word, last_word, score`` of the templates in what :func:`hits` gives."""
    votes = found.where("template is not null").withColumn("diagonal", F.col("pos") - F.col("t_pos"))
    return _spans(votes, k)


def _spans(votes: DataFrame, k: int) -> DataFrame:
    by = ["doc_id", "text_hash", "template", "label", "t_grams"]
    diagonals = votes.groupBy(*by, "diagonal").agg(F.collect_set("t_pos").alias("found"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy(*by).orderBy("diagonal", "first")
    before = F.lag(F.struct("diagonal", "last")).over(order)
    new = (before.isNull() | (F.col("diagonal") - before["diagonal"] > SHIFT) | (F.col("first") - before["last"] > GAP)).cast("int")
    numbered = diagonals.withColumn("new", new).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = numbered.groupBy(*by, "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n"), F.min("first").alias("first_word"), (F.max("last") + (k - 1)).alias("last_word"))
    return spans.select("doc_id", "text_hash", "template", "label", "first_word", "last_word", (F.col("n") / F.col("t_grams")).alias("score"))


def license_labels(docs: DataFrame, *, templates=TEMPLATES, phrases=PHRASES, k: int = K) -> DataFrame:
    """A row for each document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    found = stored(hits(docs, templates=templates, phrases=phrases, k=k), "license-hits")
    by = ("doc_id", "text_hash")
    null = F.lit(None)
    base = found.where("phrase is not null").select(*by, F.col("pos").alias("place"), F.col("phrase").alias("base"), null.cast("string").alias("added"), null.cast("double").alias("of_span")).distinct()
    best = spans(found, k).groupBy(*by, "label").agg(F.max("score").alias("of_span"))
    best = best.unionByName(found.where("short is not null").select(*by, F.col("short").alias("label"), F.lit(1.0).alias("of_span")))
    added = best.select(*by, null.cast("int").alias("place"), null.cast("string").alias("base"), F.when(F.col("of_span") >= MIN_SCORE, F.col("label")).alias("added"), "of_span")
    per = base.unionByName(added).groupBy(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash")).agg(
        F.count("place").alias("n_base"), F.min("place").cast("long").alias("first_word"), F.max("place").cast("long").alias("last_word"),
        F.array_sort(F.collect_set("base")).alias("base"), F.array_sort(F.array_distinct(F.concat(F.collect_set("base"), F.collect_set("added")))).alias("all"), F.max("of_span").alias("of_span"),
    )
    # Repeated rows are counted and come out as often.
    rows = found.where("pos < 0").groupBy(*by).agg(F.count("*").cast("int").alias("times"), F.first("n_words").alias("n_words"))
    met = rows.join(per, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left")
    n_base = F.coalesce("n_base", F.lit(0))
    score = F.greatest(F.coalesce("of_span", F.lit(0.0)), F.when(n_base > 0, PHRASE_SCORE).otherwise(0.0))
    met = met.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return met.select("doc_id", "n_words", n_base.cast("long").alias("n_base"), "first_word", "last_word", F.coalesce(F.array_join("base", ","), F.lit("")).alias("base_labels"), F.coalesce(F.array_join("all", ","), F.lit("")).alias("labels"), score.cast("double").alias("score"))
