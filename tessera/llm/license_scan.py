"""License scans by diagonal voting, in DataFrame functions only.

Templates and texts are sequences of words. All rolling three-word grams of the
texts are joined to the grams of the templates; the join compares hashes and
then the words, so each hit is verified. Hits vote for their diagonal (the place
in the text less the place in the template). Diagonals of the same text and
template that lie within `gap` words are merged, so a text with inserted
or missing words still counts as one place. A merged span is a match if its hits cover the
template's part `coverage` of the grams or more and if it isn't longer than one
and a half templates. A longer one (copies that follow closely, or words that repeat) is looked at in runs of diagonals
half a template wide: the first of the runs that overlap and cover enough is a match.

Base phrases are templates too, found where one diagonal has all their grams.

Scale: the templates are parameters, so the broadcast side has a fixed size. A text is
split into words once: one pass writes a narrow row for each text, with its
number of words and the grams whose three words all stand at their places of some
template. Only these grams are exploded, joined and verified, and only hits, of which few
texts have any, are shuffled, by text and template. Texts don't leave their tasks.

Defined results: an empty table gives an empty result; a null text is empty and has no words, a null id stays; repeated rows are texts of
their own and each get the whole result; labels are sorted, of equal scores the highest is the score; texts of any length are taken whole; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import ascii_lower, discard, materialize

#: All but 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F, stated by what a word holds: Java matches that 20 times faster.
WORD = "[0-9a-z\x80-\U0010ffff]+"
GRAM = 3
#: Diagonals of a run at most: half of the longest template that is taken.
WIDEST = 1000
#: Base phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: The method's templates and their labels: fixed wordings of well-known licenses and notices.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def template_grams(spark: SparkSession, phrases, templates) -> DataFrame:
    """(template, label, phrase, n_grams, t_place, a, b, c, h): a row for each gram of the parameters."""
    rows = []
    for number, (text, label, phrase) in enumerate([(*p, True) for p in phrases] + [(*t, False) for t in templates]):
        own = re.findall("[0-9a-z]+", text)
        if not GRAM <= len(own) <= 2 * WIDEST:
            raise ValueError(f"not of {GRAM} to {2 * WIDEST} words: {text}")
        n = len(own) - GRAM + 1
        rows += [(number, label, phrase, n, t, *own[t : t + GRAM]) for t in range(n)]
    made = spark.createDataFrame(rows, "template int, label string, phrase boolean, n_grams int, t_place int, a string, b string, c string")
    return made.withColumn("h", F.xxhash64("a", "b", "c"))


def told_apart(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(rid, doc_id, n_words, grams): a row for each text, numbered, with its words counted and the (place, a, b, c) of grams that may be a template's."""
    runs = [re.findall("[0-9a-z]+", text) for text, _ in (*phrases, *templates)]
    at = ["i", "i + 1", "i + 2"]
    near = " AND ".join(
        f"words[{at[k]}] IN ({', '.join(repr(w) for w in sorted({w for run in runs for w in run[k : len(run) - GRAM + 1 + k]}))})" for k in range(GRAM)
    )
    places = f"filter(sequence(0, size(words) - {GRAM}), i -> {near})"
    some = f"CASE WHEN size(words) >= {GRAM} THEN transform({places}, i -> struct(i AS place, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c)) END"
    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    counted = split.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").cast("long").alias("n_words"), F.expr(some).alias("grams"))
    return materialize(counted, "grams")


def hits(texts: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(rid, template, label, phrase, n_grams, t_place, place): grams of the texts at places of templates."""
    told = template_grams(texts.sparkSession, phrases, templates)
    found = texts.select("rid", F.inline("grams")).withColumn("h", F.xxhash64("a", "b", "c"))
    return found.join(F.broadcast(told), ["h", "a", "b", "c"]).drop("h", "a", "b", "c")


def spans(found: DataFrame, gap: int = 3, coverage: float = 0.8) -> DataFrame:
    """(rid, label, phrase, first, last, score): base places, and merged spans that pass."""
    key = ["rid", "template"]
    diagonals = (
        found.withColumn("diagonal", F.col("place") - F.col("t_place"))
        .groupBy(*key, "diagonal")
        .agg(
            F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("n_grams").alias("n_grams"),
            F.min("place").alias("low"), F.max("place").alias("high"), F.collect_set("t_place").alias("cover"),
        )
    )
    base = diagonals.filter(F.col("phrase") & (F.size("cover") == F.col("n_grams"))).select(
        "rid", "label", "phrase", F.col("low").alias("first"), F.col("low").alias("last"), F.lit(1.0).alias("score")
    )
    along = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > gap, F.lit(True)).cast("int")
    islands = diagonals.filter(~F.col("phrase")).withColumn("apart", apart).withColumn("island", F.sum("apart").over(along))
    merged = (
        islands.groupBy(*key, "island")
        .agg(
            F.first("label").alias("label"), F.first("n_grams").alias("n_grams"), F.min("low").alias("first"), F.max("high").alias("high"),
            F.size(F.array_distinct(F.flatten(F.collect_list("cover")))).alias("covered"),
        )
        .withColumn("score", F.col("covered") / F.col("n_grams"))
        .filter(F.col("score") >= coverage)
    )
    fits = F.col("high") - F.col("first") + GRAM <= 1.5 * (F.col("n_grams") + GRAM - 1)
    wide = F.floor((F.col("n_grams") + GRAM - 1) / 2)
    within = Window.partitionBy(*key, "island").orderBy("diagonal")
    # templates are parameters, so the widest run has a fixed size
    ahead = F.collect_list(F.struct("diagonal", "low", "high", "cover")).over(within.rangeBetween(0, WIDEST))
    own = islands.join(merged.filter(~fits).select(*key, "island"), [*key, "island"], "left_semi").withColumn("ahead", ahead)
    runs = (
        own.withColumn("ahead", F.filter("ahead", lambda d: d.diagonal <= F.col("diagonal") + wide))
        .withColumn("score", F.size(F.array_distinct(F.flatten("ahead.cover"))) / F.col("n_grams"))
        .filter(F.col("score") >= coverage)
        .withColumn("back", F.col("diagonal") - F.lag("diagonal").over(within))
        .filter(F.col("back").isNull() | (F.col("back") > wide))
    )
    told = [merged.filter(fits).select("rid", "label", "first", F.col("high").alias("last"), "score"), runs.select("rid", "label", F.array_min("ahead.low").alias("first"), F.array_max("ahead.high").alias("last"), "score")]
    return base.unionByName(told[0].unionByName(told[1]).withColumn("phrase", F.lit(False)))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, gap: int = 3, coverage: float = 0.8) -> DataFrame:
    """One row for each row of *docs* (doc_id, text): base places and labels, all labels, and the best score."""

    def joined(column: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(column)), ",")

    start = F.when(F.col("phrase"), F.col("first"))
    texts = told_apart(docs, phrases, templates)
    found = materialize(hits(texts, phrases, templates), "hits")
    results = materialize(
        spans(found, gap, coverage)
        .groupBy("rid")
        .agg(
            F.count_if("phrase").alias("n_base"), F.min(start).cast("long").alias("first_word"), F.max(start).cast("long").alias("last_word"),
            joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("score").alias("score"),
        ),
        "licenses",
    )
    discard(found)
    return texts.select("rid", "doc_id", "n_words").join(results, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
