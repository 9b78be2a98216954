"""License scans by diagonal voting, in DataFrame operations only.

Every run of ``GRAM`` words of every document is hashed and joined to the same runs of the license
templates. A hit at word i of the document and word j of the template votes for the diagonal i - j. A
diagonal with all votes of a template is a place where the template stands word for word; that is how
the base phrases are found. For longer notices neighbouring diagonals (words left out or put in) are
merged, and a notice counts when the merged span covers enough of the template's words. One changed word
takes away up to GRAM runs, and the words between it and a close end or another change go with them; so
spans that fall short by this much at most are verified: the words on their diagonals are compared.

Votes of a diagonal are a bit mask of template positions, so hits fold to one short row where they are
read; templates have at most 63 + GRAM - 1 words. The score stays the share of runs. Template runs number a few hundred whatever the
input, so their broadcast is bounded by the parameter.

Defined results: null and empty texts have no words and no labels (empty strings, score 0, first and
last word null); repeated rows and rows without an id are reported each; equal (id, text) rows get
equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise.llm.common import ascii_lower, stored

GRAM = 3
COVER = 0.8  # share of a notice's words that must be found
GAP = 4  # diagonals this close belong to one span
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases that count at every place, and the label of each.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Opening sentences of public license notices; labels the method adds.
NOTICES = [
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "mit-text",
    ),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "gpl-text",
    ),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def runs(df: DataFrame, words: str, *keep: str) -> DataFrame:
    """One row per run of GRAM words: its position, its words and their hash."""
    w = F.col(words)
    shifted = [F.slice(w, i + 1, F.size(w)).alias(f"w{i}") for i in range(GRAM)]
    rows = df.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("at", "run"))
    # The last GRAM - 1 runs are cut off by the end of the text, and all runs of a shorter one. A filter by the number
    # of words would be moved to where rows are read, and cut every text into words a second time.
    rows = rows.filter(F.col(f"run.w{GRAM - 1}").isNotNull())
    parts = [F.col(f"run.w{i}").alias(f"w{i}") for i in range(GRAM)]
    return rows.select(*keep, "at", *parts).withColumn("h", F.xxhash64(*[f"w{i}" for i in range(GRAM)]))


def templates(spark, base=BASE, notices=NOTICES) -> DataFrame:
    rows = []
    for number, (text, label) in enumerate([*base, *notices]):
        found = re.findall(r"[0-9a-z]+", text)
        if not GRAM <= len(found) <= 62 + GRAM:
            raise ValueError(f"a template needs {GRAM} to {62 + GRAM} words: {text!r}")
        rows.append((number, label, number < len(base), found, len(found) - GRAM + 1))
    return spark.createDataFrame(rows, "template int, label string, base boolean, words array<string>, n_runs int")


def votes(docs: DataFrame, keys: list[str], text: str = "text", **templates_) -> DataFrame:
    """(keys, template, label, base, n_runs, diagonal, mask): the template positions that voted."""
    known = templates(docs.sparkSession, **templates_)
    seeds = runs(known, "words", "template", "label", "base", "n_runs").withColumnRenamed("at", "j")
    rows = runs(docs.select(*keys, words_of(F.col(text)).alias("words")), "words", *keys).withColumnRenamed("at", "i")
    same = [F.col(f"d.w{i}") == F.col(f"t.w{i}") for i in range(GRAM)]
    on = F.col("d.h") == F.col("t.h")
    for s in same:
        on = on & s
    hits = rows.alias("d").join(F.broadcast(seeds.alias("t")), on)
    diagonal = (F.col("i") - F.col("j")).alias("diagonal")
    bit = F.expr("shiftleft(1L, j)")
    return hits.groupBy(*keys, "template", "label", "base", "n_runs", diagonal).agg(F.bit_or(bit).alias("mask"))


def spans(voted: DataFrame, keys: list[str], gap: int = GAP) -> DataFrame:
    """Neighbouring diagonals merged: (keys, template, label, base, n_runs, start, mask, diagonals)."""
    one = Window.partitionBy(*keys, "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(one) > gap, F.lit(True))
    marked = voted.withColumn("span", F.sum(far.cast("int")).over(one))
    return marked.groupBy(*keys, "template", "label", "base", "n_runs", "span").agg(
        F.min("diagonal").alias("start"), F.bit_or("mask").alias("mask"), F.collect_set("diagonal").alias("diagonals")
    )


def words_covered(mask: Column) -> Column:
    """Number of template words in the runs of a mask; words from the 65th on have a mask of their own."""
    low, high = mask, F.lit(0).cast("long")
    for shift in range(1, GRAM):
        low = low.bitwiseOR(F.shiftleft(mask, shift))
        high = high.bitwiseOR(F.shiftrightunsigned(mask, 64 - shift))
    return F.bit_count(low) + F.bit_count(high)


def verified(docs: DataFrame, unclear: DataFrame, keys: list[str], text: str = "text", **templates_) -> DataFrame:
    """(keys, template, span, same): the template words that stand on the diagonals of the spans ``unclear``."""
    known = F.broadcast(templates(docs.sparkSession, **templates_).select("template", F.col("words").alias("wanted")))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"d.{k}").eqNullSafe(F.col(f"u.{k}"))
    asked = docs.alias("d").join(unclear.join(known, "template").alias("u"), on)
    asked = asked.select(*[f"u.{k}" for k in keys], "u.template", "u.span", "u.wanted", "u.diagonals", words_of(F.col(f"d.{text}")).alias("w"))

    def there(word: Column, j: Column) -> Column:
        return F.exists("diagonals", lambda d: F.coalesce(F.get(F.col("w"), (d + j).cast("int")) == word, F.lit(False)))

    at = F.transform("wanted", lambda word, j: there(word, j))
    return asked.withColumn("same", F.size(F.filter(at, lambda x: x))).groupBy(*keys, "template", "span").agg(F.max("same").alias("same"))


def scan(docs: DataFrame, text: str = "text", cover: float = COVER, **templates_) -> DataFrame:
    """The documents' ids with word counts, base places, labels and score."""
    key = ["doc_id", "hash"]
    keyed = docs.select("doc_id", F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    counted = keyed.select(*key, F.coalesce(F.regexp_count("text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long").alias("n_words"))
    # Equal rows vote for the same bits, so copies change nothing.
    voted = stored(votes(keyed, key, **templates_), "votes")
    # Base phrases count on single diagonals, notices on merged ones.
    base = voted.filter("base").withColumnRenamed("diagonal", "start").withColumn("named", F.lit(False))
    share = words_covered(F.col("mask")) / (F.col("n_runs") + GRAM - 1)
    merged = spans(voted.filter(~F.col("base")), key).withColumn("share", share)
    # Each missing word takes GRAM words away at most.
    unclear = merged.filter((F.col("share") < cover) & (F.col("share") >= 1 - GRAM * (1 - cover) - 1e-9))
    unclear = stored(unclear.select(*key, "template", "span", "diagonals"), "unclear")
    same = verified(keyed, unclear, key, **templates_)
    on = (F.col("m.template") == F.col("v.template")) & (F.col("m.span") == F.col("v.span"))
    for k in key:
        on = on & F.col(f"m.{k}").eqNullSafe(F.col(f"v.{k}"))
    counted_words = F.coalesce(F.col("v.same") / (F.col("m.n_runs") + GRAM - 1), F.lit(0.0))
    named = (F.greatest(F.col("m.share"), counted_words) >= cover).alias("named")
    notices = merged.alias("m").join(same.alias("v"), on, "left").select(*[f"m.{c}" for c in base.columns if c != "named"], named)
    placed = base.unionByName(notices)
    covered = F.bit_count("mask") / F.col("n_runs")
    full = F.col("base") & (covered == 1)
    found = placed.groupBy(*key).agg(
        F.count_if(full).alias("n_base"),
        F.min(F.when(full, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(full, F.col("start"))).cast("long").alias("last_word"),
        F.collect_set(F.when(full, F.col("label"))).alias("base_set"),
        F.collect_set(F.when(F.col("named"), F.col("label"))).alias("more_set"),
        F.max(covered).alias("score"),
    )
    same = F.col("c.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("c.hash").eqNullSafe(F.col("f.hash"))
    joined = counted.alias("c").join(found.alias("f"), same, "left")
    none = F.array().cast("array<string>")
    base = F.array_sort(F.coalesce("base_set", none))
    labels = F.array_sort(F.array_union(base, F.coalesce("more_set", none)))
    return joined.select(
        "c.doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
    )
