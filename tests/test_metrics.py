"""Classification metrics, ranked scores and curves against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from keepwise.functions.features import decision
from keepwise.operators import metrics as mt


def brute_curve(pairs, drop):
    scores = sorted({p for _, p in pairs}, reverse=True)
    fps = [sum(1 for y, p in pairs if p >= s and y == 0) for s in scores]
    tps = [sum(1 for y, p in pairs if p >= s and y == 1) for s in scores]
    keep = range(len(scores))
    if drop and len(scores) > 2:
        def bend(v, i):
            return v[i + 1] - 2 * v[i] + v[i - 1] != 0
        inner = [i for i in range(1, len(scores) - 1) if bend(fps, i) or bend(tps, i)]
        keep = [0, *inner, len(scores) - 1]
    points = [(scores[i], fps[i] / fps[-1], tps[i] / tps[-1]) for i in keep]
    return sorted([(float("inf"), 0.0, 0.0), *points])


def test_hand_computed_metrics(outcomes):
    row = mt.compute_metrics(outcomes, 0.5).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.75, 0.75, 0.75, 0.75)
    assert row["roc_auc"] == 0.8125
    assert mt.roc_auc(outcomes).first()[0] == 0.8125
    assert mt.compute_metrics(outcomes, 1.0).first()["precision"] == 0.0


def test_thresholds(spark, outcomes):
    df = spark.createDataFrame([(0.5,), (0.49,)], "p double")
    assert [r[0] for r in df.select(decision(F.col("p"), 0.5)).collect()] == [1, 0]
    for bad in (-0.1, 1.5):
        with pytest.raises(ValueError, match=r"\[0, 1\]"):
            decision(F.col("p"), bad)
        with pytest.raises(ValueError, match=r"\[0, 1\]"):
            mt.threshold_table(outcomes, [bad])
    table = mt.threshold_table(outcomes).collect()
    assert [r["threshold"] for r in table] == [0.3, 0.4, 0.5, 0.6, 0.7]
    assert [r["recall"] for r in table] == sorted([r["recall"] for r in table], reverse=True)
    at_half = table[2]
    assert (at_half["flaggade_kunder"], at_half["missade_churnare"]) == (4, 1)
    one_class = outcomes.filter("y_true = 0")
    assert [r["recall"] for r in mt.threshold_table(one_class).collect()] == [0.0] * 5
    with pytest.raises(Exception, match="both classes"):
        mt.compute_metrics(one_class).collect()


def test_confusion_and_report(outcomes):
    cells = {(r["sant"], r["predikterat"]): r["antal"] for r in mt.confusion_matrix(outcomes).collect()}
    assert cells == {(0, 0): 3, (0, 1): 1, (1, 0): 1, (1, 1): 3}
    report = {r["klass"]: r for r in mt.classification_report(outcomes, 0.35).collect()}
    assert list(report) == ["Stannar", "Churnar", "accuracy", "macro avg", "weighted avg"]
    assert report["Stannar"]["precision"] == pytest.approx(2 / 3)
    assert report["Churnar"]["recall"] == pytest.approx(3 / 4)
    assert report["accuracy"]["f1"] == pytest.approx(5 / 8)
    assert report["macro avg"]["support"] == 8


@pytest.mark.parametrize("buckets", [1024, 4])
@pytest.mark.parametrize("kind", ["ties", "crowded", "constant"])
def test_ranking_with_hot_scores(spark, buckets, kind):
    """A third of the rows on one score, or all scores within a hair of each other."""
    rng = random.Random(3)
    draw = {
        "ties": lambda: 0.37 if rng.random() < 0.34 else rng.randrange(40) / 40,
        "crowded": lambda: 0.5 + rng.random() * 1e-9,
        "constant": lambda: 0.5,
    }[kind]
    pairs = [(int(rng.random() < 0.3), draw()) for _ in range(600)]
    df = spark.createDataFrame(pairs, "y_true int, churn_probability double")
    ranked = mt.ranked_scores(df, buckets=buckets)
    for row in ranked.collect():
        assert row["tps"] == sum(1 for y, p in pairs if y == 1 and p >= row["score"])
        assert row["fps"] == sum(1 for y, p in pairs if y == 0 and p >= row["score"])
    exact = BinaryClassificationEvaluator(
        rawPredictionCol="churn_probability", labelCol="y_true", numBins=0
    ).evaluate(df)
    assert mt.roc_auc(df).first()[0] == pytest.approx(exact)
    for drop in (False, True):
        points = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in mt.roc_points(df, drop).collect())
        for mine, theirs in zip(points, brute_curve(pairs, drop), strict=True):
            assert mine == pytest.approx(theirs)


def test_r2(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.5)], "y double, f double")
    mean = 7 / 3
    expected = 1 - 0.5 / sum((v - mean) ** 2 for v in (1, 2, 4))
    assert mt.r2(df, "y", "f").first()[0] == pytest.approx(expected)
