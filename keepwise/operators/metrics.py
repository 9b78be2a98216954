"""Classification and regression metrics from (true class, probability) rows.

Rows are first folded to one row per distinct score, which settles ties and hot scores.
Ranking then needs a running total over the scores: they are cut into buckets at approximate
quantiles of the *distinct* scores, so buckets stay even however the scores crowd together;
the window runs inside a bucket and the few bucket totals supply the offset.
"""

from __future__ import annotations

import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise.functions.features import check_threshold
from keepwise.functions.numbers import guarded
from keepwise.schema import PROBABILITY
from keepwise.session import table_path, write_table

# Thresholds of the overview table and display names of the classes.
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]
CLASS_NAMES = ["Stannar", "Churnar"]

BUCKETS = 1024


def score_counts(df: DataFrame, y: str = "y_true", p: str = PROBABILITY) -> DataFrame:
    """(score, pos, neg): one row per distinct score."""
    return df.groupBy(F.col(p).cast("double").alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )


def ranked_scores(df: DataFrame, y: str = "y_true", p: str = PROBABILITY, buckets: int = BUCKETS) -> DataFrame:
    """Per distinct score from the highest down: counts, and counts including all higher scores.

    Columns: score, bucket, pos, neg, tps, fps, P, N.
    """
    scores = score_counts(df, y, p)
    cuts = [i / buckets for i in range(1, buckets)]
    found = scores.agg(F.percentile_approx("score", cuts, 10 * buckets)).first()[0] or []
    splits = [float("-inf"), *sorted(set(found)), float("inf")]
    bucketed = Bucketizer(inputCol="score", outputCol="bucket", splits=splits).transform(scores)

    # At most `buckets` rows: safe for one window task and for a broadcast.
    everything = Window.orderBy(F.desc("bucket"))
    above = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = (
        bucketed.groupBy("bucket")
        .agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
        .select(
            "bucket",
            F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_above_p"),
            F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above_n"),
            F.sum("_p").over(whole).alias("P"),
            F.sum("_n").over(whole).alias("N"),
        )
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("score"))
    return bucketed.join(F.broadcast(offsets), "bucket").select(
        "score",
        "bucket",
        "pos",
        "neg",
        (F.sum("pos").over(inside) + F.col("_above_p")).alias("tps"),
        (F.sum("neg").over(inside) + F.col("_above_n")).alias("fps"),
        "P",
        "N",
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2 * tp, 2 * tp + fp + fn)


def _auc() -> Column:
    """Share of (positive, negative) pairs ranked right, ties counting half."""
    wins = F.sum(F.col("neg").cast("double") * ((F.col("tps") - F.col("pos")) + F.col("pos") / 2))
    pairs = F.max(F.col("P").cast("double") * F.col("N"))
    single = F.coalesce(pairs, F.lit(0.0)) == 0
    return guarded(wins / F.nullif(pairs, F.lit(0.0)), single, "both classes are needed for metrics")


def roc_auc(df: DataFrame, y: str = "y_true", p: str = PROBABILITY) -> DataFrame:
    """Exact, tie-aware area under the ROC curve."""
    return ranked_scores(df, y, p).agg(_auc().alias("roc_auc"))


def roc_auc_by(df: DataFrame, keys: list[str], y: str = "y_true", p: str = PROBABILITY) -> DataFrame:
    """(keys, roc_auc) for many rankings at once; null where a key has a single class.

    Distinct scores are laid out by range of (keys, score) and written, so that a key may hold any share of
    the rows. Running totals are taken inside a range; the totals of the ranges above come from one row per key
    and range.
    """
    spark = df.sparkSession
    counted = df.groupBy(*keys, F.col(p).cast("double").alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    ranges = counted.repartitionByRange(*keys, "score").withColumn("range", F.spark_partition_id())
    # Written, since a range is only known where the row was laid out.
    laid = write_table(ranges, table_path(spark, "rankings", uuid.uuid4().hex))
    per_key = Window.partitionBy(*keys)
    above = per_key.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy(*keys, "range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    totals = totals.select(
        *keys,
        "range",
        F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_above"),
        F.sum("_p").over(per_key).alias("P"),
        F.sum("_n").over(per_key).alias("N"),
    )
    inside = Window.partitionBy(*keys, "range").orderBy(F.desc("score"))
    higher = laid.withColumn("_inside", F.sum("pos").over(inside) - F.col("pos"))
    wins = higher.join(totals, [*keys, "range"]).groupBy(*keys).agg(
        F.sum(F.col("neg").cast("double") * (F.col("_above") + F.col("_inside") + F.col("pos") / 2)).alias("_wins"),
        F.first("P").alias("P"),
        F.first("N").alias("N"),
    )
    pairs = F.nullif(F.col("P").cast("double") * F.col("N"), F.lit(0.0))
    return wins.select(*keys, (F.col("_wins") / pairs).alias("roc_auc"))


def compute_metrics(df: DataFrame, threshold: float = 0.5, y: str = "y_true", p: str = PROBABILITY) -> DataFrame:
    """One row: accuracy, precision, recall, f1, roc_auc. Data with a single class fails the query."""
    check_threshold(threshold)
    flagged = F.col("score") >= F.lit(float(threshold))

    def total(column, rows):
        return F.coalesce(F.sum(F.when(rows, F.col(column))), F.lit(0))

    cells = ranked_scores(df, y, p).agg(
        total("pos", flagged).alias("tp"),
        total("neg", flagged).alias("fp"),
        total("pos", ~flagged).alias("fn"),
        total("neg", ~flagged).alias("tn"),
        _auc().alias("roc_auc"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select(
        # The area carries the check for a single class, and all figures depend on it.
        F.when(
            F.col("roc_auc").isNotNull(),
            F.struct(
                _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                _ratio(tp, tp + fp).alias("precision"),
                _ratio(tp, tp + fn).alias("recall"),
                _f1(tp, fp, fn).alias("f1"),
                "roc_auc",
            ),
        ).alias("_m")
    ).select("_m.*")


def _cells(df: DataFrame, thresholds: list[float], y: str, p: str) -> DataFrame:
    """Four counts per threshold as rows, from one scan."""
    for t in thresholds:
        check_threshold(t)
    flagged = [F.col(p) >= F.lit(float(t)) for t in thresholds]
    churned, stayed = F.col(y) == 1, F.col(y) == 0
    counts = []
    for i, hit in enumerate(flagged):
        for name, rows in {
            "tp": churned & hit,
            "fp": stayed & hit,
            "fn": churned & ~hit,
            "tn": stayed & ~hit,
        }.items():
            counts.append(F.count_if(rows).alias(f"{name}{i}"))
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            *[F.col(f"{name}{i}").alias(name) for name in ("tp", "fp", "fn", "tn")],
        )
        for i, t in enumerate(thresholds)
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def threshold_table(
    df: DataFrame, thresholds: list[float] = THRESHOLDS, y: str = "y_true", p: str = PROBABILITY
) -> DataFrame:
    """Precision, recall, f1, flagged and missed customers per threshold; one class is allowed."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return _cells(df, thresholds, y, p).select(
        "threshold",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
        (tp + fp).alias("flaggade_kunder"),
        fn.alias("missade_churnare"),
    )


def confusion_matrix(df: DataFrame, threshold: float = 0.5, y: str = "y_true", p: str = PROBABILITY) -> DataFrame:
    """(sant, predikterat, antal): always four rows."""
    cells = [("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)]
    rows = [
        F.struct(F.lit(true).alias("sant"), F.lit(pred).alias("predikterat"), F.col(c).alias("antal"))
        for c, true, pred in cells
    ]
    return _cells(df, [threshold], y, p).select(F.inline(F.array(*rows)))


def roc_points(
    df: DataFrame, drop_collinear: bool = True, y: str = "y_true", p: str = PROBABILITY
) -> DataFrame:
    """(threshold, fpr, tpr) from the origin (threshold infinity) to (1, 1).

    With ``drop_collinear`` an inner point goes when the step to it equals the step from it;
    the step after a bucket's last score is that bucket's successor's first step.
    """
    ranked = ranked_scores(df, y, p)
    if drop_collinear:
        inside = Window.partitionBy("bucket").orderBy(F.desc("score"))
        heads = ranked.groupBy("bucket").agg(
            F.max_by("pos", "score").alias("_hp"), F.max_by("neg", "score").alias("_hn")
        )
        following = Window.orderBy(F.desc("bucket"))
        heads = heads.select(
            "bucket",
            F.lead("_hp").over(following).alias("_next_p"),
            F.lead("_hn").over(following).alias("_next_n"),
        )
        ranked = (
            ranked.join(F.broadcast(heads), "bucket")
            .withColumn("_next_p", F.coalesce(F.lead("pos").over(inside), F.col("_next_p")))
            .withColumn("_next_n", F.coalesce(F.lead("neg").over(inside), F.col("_next_n")))
        )
        first = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
        last = F.col("_next_p").isNull()
        turn = (F.col("_next_p") != F.col("pos")) | (F.col("_next_n") != F.col("neg"))
        ranked = ranked.filter(first | last | turn)
    points = ranked.select(
        F.col("score").alias("threshold"),
        (F.col("fps") / F.col("N")).alias("fpr"),
        (F.col("tps") / F.col("P")).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.union(points)


def classification_report(
    df: DataFrame, threshold: float = 0.5, y: str = "y_true", p: str = PROBABILITY
) -> DataFrame:
    """(klass, precision, recall, f1, support): two classes, accuracy, macro and weighted means."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    stay = (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _f1(tn, fn, fp), tn + fp)
    churn = (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _f1(tp, fp, fn), tp + fn)
    n = tp + fp + fn + tn
    accuracy = _ratio(tp + tn, n)
    macro = [(a + b) / 2 for a, b in zip(stay[:3], churn[:3], strict=True)]
    weighted = [_ratio(a * stay[3] + b * churn[3], n) for a, b in zip(stay[:3], churn[:3], strict=True)]
    table = [
        (CLASS_NAMES[0], *stay),
        (CLASS_NAMES[1], *churn),
        ("accuracy", accuracy, accuracy, accuracy, n),
        ("macro avg", *macro, n),
        ("weighted avg", *weighted, n),
    ]
    names = ("precision", "recall", "f1", "support")
    rows = [
        F.struct(F.lit(k).alias("klass"), *[v.alias(c) for v, c in zip(values, names, strict=True)])
        for k, *values in table
    ]
    return _cells(df, [threshold], y, p).select(F.inline(F.array(*rows)))


def r2(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """Coefficient of determination in one pass."""
    error = F.sum(F.pow(F.col(y) - F.col(predicted), 2))
    spread = F.var_pop(y) * F.count(y)
    return df.agg((1 - error / spread).alias("r2"))
