"""Splits, folds and class weights."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keepwise.operators import prepare, split


def table(spark, labels):
    return spark.createDataFrame([(f"c{i}", float(y)) for i, y in enumerate(labels)], "customerID string, label double")


def ranked(labels, c):
    ids = [f"c{i}" for i, y in enumerate(labels) if y == c]
    return sorted(ids, key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())


def test_sixty_rows(raw):
    parts = split.split_data(prepare.features_with_label(raw)).groupBy("part", "label").count().collect()
    assert {(r["part"], r["label"]): r["count"] for r in parts} == {
        (p, y): n for p, n in [("train", 18), ("validation", 6), ("test", 6)] for y in (0.0, 1.0)
    }


@pytest.mark.parametrize(("digits", "bucket_rows"), [(1, 1_000_000), (3, 1_000_000), (1, 1), (2, 5)])
@pytest.mark.parametrize("labels", [[i % 3 == 0 for i in range(997)], [i < 5 for i in range(23)], [0] * 7 + [1]])
def test_split_equals_sorting_by_hash(spark, labels, digits, bucket_rows):
    labels = [int(y) for y in labels]
    df = split.assign(table(spark, labels), "part", split.part_sizes, digits=digits, bucket_rows=bucket_rows)
    got = {r["customerID"]: r["part"] for r in df.collect()}
    sizes = split.part_sizes(Counter(labels))
    for c in set(labels):
        order = ranked(labels, c)
        expected = [p for p, n in sizes[c] for _ in range(n)]
        assert [got[i] for i in order] == expected
    n = len(labels)
    total = Counter(got.values())
    assert total["test"] == math.ceil(0.2 * n)
    assert total["validation"] == math.ceil(0.25 * (n - total["test"]))


def test_folds_are_even_and_stratified(spark):
    labels = [int(i % 4 == 0) for i in range(203)]
    rows = split.with_folds(table(spark, labels)).collect()
    for c in (0, 1):
        sizes = Counter(r["fold"] for r in rows if r["label"] == c)
        assert set(sizes) == set(range(5))
        assert max(sizes.values()) - min(sizes.values()) <= 1


def test_copies_of_a_hot_id_stay_together(spark):
    labels = [0] * 300
    hot = spark.range(150).select(F.lit("c7").alias("customerID"), F.lit(0.0).alias("label"))
    rows = split.assign(table(spark, labels).union(hot), "part", split.part_sizes, bucket_rows=20).collect()
    assert len(rows) == 450
    parts = {}
    for r in rows:
        parts.setdefault(r["customerID"], set()).add(r["part"])
    assert all(len(p) == 1 for p in parts.values())


def test_split_is_deterministic_and_seeded(spark):
    df = table(spark, [int(i % 2) for i in range(100)])
    first, again, other = (
        {r["customerID"]: r["part"] for r in split.split_data(df.repartition(n), s).collect()}
        for n, s in [(1, 42), (5, 42), (5, 7)]
    )
    assert first == again != other


def test_class_weights(spark):
    rows = split.class_weights(table(spark, [1] * 10 + [0] * 30)).collect()
    assert {r["label"]: r["weight"] for r in rows} == {0.0: 40 / 60, 1.0: 40 / 20}
