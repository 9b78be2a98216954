"""Descriptive aggregates over customers."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.functions import features as X
from keepwise.functions.numbers import number
from keepwise.operators.prepare import with_churn_flag
from keepwise.operators.quality import require_columns
from keepwise.operators.quantiles import exact_quantiles
from keepwise.schema import NUMERIC, TARGET

QUARTILES = [0.25, 0.5, 0.75]
STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def churn_rate_by(df: DataFrame, column: str) -> DataFrame:
    """Churn share and customers per level of a raw or derived column, highest share first."""
    data = with_churn_flag(df)
    require_columns(data, column)
    return _share(data.filter(F.col(column).isNotNull()), [column]).orderBy(
        F.desc("churn_andel"), column
    )


def _share(data: DataFrame, keys: list[str]) -> DataFrame:
    return data.groupBy(*keys).agg(
        F.avg("churn_flag").alias("churn_andel"), F.count("*").alias("antal_kunder")
    )


def churn_rate_with_mean(df: DataFrame, column: str) -> DataFrame:
    """Group shares beside the overall share (column snitt), as in the category chart."""
    overall = df.agg(F.avg(X.churn_flag())).scalar()
    return churn_rate_by(df, column).withColumn("snitt", overall)


def churn_rate_by_price_band(df: DataFrame) -> DataFrame:
    """Churn share and customers per price band, in band order."""
    require_columns(df, "MonthlyCharges")
    charge = number(df, "MonthlyCharges")
    banded = df.select(
        X.churn_flag().alias("churn_flag"),
        X.price_band_order(charge).alias("_order"),
        X.price_band(charge).alias("prisintervall"),
    ).filter(F.col("_order").isNotNull())
    shares = _share(banded, ["_order", "prisintervall"]).orderBy("_order")
    return shares.drop("_order")


def churn_correlations(df: DataFrame) -> DataFrame:
    """Correlation of each numeric column with churn, ascending, pairs complete."""
    data = with_churn_flag(df)
    wide = data.agg(*[F.corr(F.col(c).cast("double"), "churn_flag").alias(c) for c in NUMERIC])
    return wide.unpivot([], NUMERIC, "kolumn", "korrelation").orderBy("korrelation", "kolumn")


def correlation_matrix(df: DataFrame, columns: list[str] = NUMERIC) -> DataFrame:
    """(a, b, r) for all ordered pairs of numeric columns, each pair on its complete rows.

    One scan lists the unordered pairs of each row and correlates per pair, pre-aggregated
    where the row is read; as many correlations side by side would not be JIT-compiled.
    """
    pairs = list(combinations_with_replacement(columns, 2))
    data = with_churn_flag(df)
    rows = [
        F.struct(F.lit(i).alias("i"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for i, (a, b) in enumerate(pairs)
    ]
    found = data.select(F.inline(F.array(*rows))).groupBy("i").agg(F.corr("x", "y").alias("r"))
    cells = [
        F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"))
        for i, pair in enumerate(pairs)
        for a, b in sorted({pair, pair[::-1]}, key=lambda p: p != pair)
    ]
    names = df.sparkSession.range(1).select(F.inline(F.array(*cells)))
    # Both sides hold at most one row per pair of columns.
    return names.join(F.broadcast(found), "i", "left").select("a", "b", "r")


def target_share(df: DataFrame) -> DataFrame:
    """Customers and share of all rows per target level, largest first."""
    total = df.agg(F.count("*")).scalar()
    counts = df.groupBy(TARGET).agg(F.count("*").alias("antal"))
    shares = counts.filter(F.col(TARGET).isNotNull()).withColumn("andel", F.col("antal") / total)
    return shares.orderBy(F.desc("antal"), TARGET)


def _describe_row(name: str, value, quartiles: list) -> list:
    q25, q50, q75 = (F.lit(q).cast("double") for q in quartiles)
    return [
        F.count(value).cast("double").alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        q25.alias("25%"),
        q50.alias("50%"),
        q75.alias("75%"),
        F.max(value).cast("double").alias("max"),
    ]


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, stat..): count, mean, std, min, exact quartiles and max of numeric columns."""
    values = {c: number(df, c).cast("double") for c in columns}
    quartiles = exact_quantiles(df, values, QUARTILES)
    wide = df.agg(*[F.struct(*_describe_row(c, values[c], quartiles[c])).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}`.`{s}`") for s in STATS]) for c in columns]
    return wide.select(F.inline(F.array(*rows)))


def describe_by_churn(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, stat, stannar, churnar): describe() per churn class, side by side."""
    data = with_churn_flag(df)
    classes = {"stannar": 0.0, "churnar": 1.0}
    values = {
        f"{c}|{name}": F.when(F.col("churn_flag") == flag, F.col(c).cast("double"))
        for c in columns
        for name, flag in classes.items()
    }
    quartiles = exact_quantiles(data, values, QUARTILES)
    wide = data.agg(
        *[F.struct(*_describe_row(key, value, quartiles[key])).alias(key) for key, value in values.items()]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(stat).alias("stat"),
            *[F.col(f"`{c}|{name}`.`{stat}`").alias(name) for name in classes],
        )
        for c in columns
        for stat in STATS
    ]
    return wide.select(F.inline(F.array(*rows)))


def tenure_histogram(df: DataFrame, step: int = 6) -> DataFrame:
    """Customers per tenure bin and target level."""
    start = (F.floor(number(df, "tenure") / step) * step).cast("int")
    return (
        df.select(start.alias("tenure_bin"), TARGET)
        .filter(F.col("tenure_bin").isNotNull())
        .groupBy("tenure_bin", TARGET)
        .agg(F.count("*").alias("antal"))
        .orderBy("tenure_bin", TARGET)
    )


def class_histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram of a column per churn class over the class's own range.

    Bins are left-closed, the last one closed on both sides, and empty bins are kept.
    """
    require_columns(df, column)
    data = with_churn_flag(df).select(F.col("churn_flag").alias("churn"), F.col(column).cast("double").alias("v"))
    data = data.filter(F.col("v").isNotNull())
    ranges = data.groupBy("churn").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    spans = {}
    for row in ranges:
        flat = 0.5 if row["lo"] == row["hi"] else 0.0
        spans[row["churn"]] = (row["lo"] - flat, row["hi"] + flat)

    lo = hi = F.lit(None).cast("double")
    for churn, (low, high) in spans.items():
        lo = F.when(F.col("churn") == churn, low).otherwise(lo)
        hi = F.when(F.col("churn") == churn, high).otherwise(hi)
    placed = data.withColumns({"lo": lo, "hi": hi})
    placed = placed.withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    raw = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    placed = placed.withColumn("raw", raw.cast("int"))
    # A value on an edge belongs to the bin that starts there, whatever the division rounded to.
    edge = F.col("lo") + F.col("raw") * F.col("step")
    next_edge = F.col("lo") + (F.col("raw") + 1) * F.col("step")
    bin_no = (
        F.when(F.col("v") < edge, F.col("raw") - 1)
        .when((F.col("v") >= next_edge) & (F.col("raw") < bins - 1), F.col("raw") + 1)
        .otherwise(F.col("raw"))
    )
    counts = placed.groupBy("churn", bin_no.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame(
        [
            (churn, i, low + i * (high - low) / bins, low + (i + 1) * (high - low) / bins)
            for churn, (low, high) in spans.items()
            for i in range(bins)
        ],
        "churn double, bin int, bin_start double, bin_end double",
    )
    # The grid has bins x classes rows, and so has the grouped side at most.
    filled = F.broadcast(counts).join(grid, ["churn", "bin"], "right")
    return filled.select(
        F.col("churn").cast("int").alias("churn"),
        "bin",
        "bin_start",
        "bin_end",
        F.coalesce("n", F.lit(0)).alias("antal"),
    ).orderBy("churn", "bin")


def headline_means(df: DataFrame) -> DataFrame:
    """Customers, churn share, mean tenure and mean monthly charge."""
    return df.agg(
        F.count("*").alias("kunder"),
        F.avg(X.churn_flag()).alias("churn_andel"),
        F.avg(number(df, "tenure")).alias("medelkundtid"),
        F.avg(number(df, "MonthlyCharges")).alias("medelmanadskostnad"),
    )


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, median): defaults for a numeric input."""
    values = {c: number(df, c) for c in columns}
    found = exact_quantiles(df, values, [0.5])
    rows = [(c, found[c][0]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, median double")


def charge_deviation(df: DataFrame, limit: float = 1.0) -> DataFrame:
    """How often the average charge differs from the current one by more than ``limit``.

    The share is over all customers, those without an average charge included; the
    statistics are over customers that have one.
    """
    data = with_churn_flag(df).select(
        F.abs(F.col("avg_monthly_charge") - F.col("MonthlyCharges")).alias("deviation")
    )
    share = data.agg(F.avg(F.coalesce((F.col("deviation") > limit).cast("double"), F.lit(0.0)))).scalar()
    return describe(data, ["deviation"]).withColumn("share_above_limit", share)


