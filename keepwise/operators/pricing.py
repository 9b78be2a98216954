"""What each service adds to the monthly charge, by least squares on one-hot services."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.functions.numbers import guarded, number
from keepwise.operators.metrics import r2
from keepwise.operators.quality import require_columns
from keepwise.operators.split import SEED, assign, holdout_sizes
from keepwise.schema import ID, PRICE_FEATURES

CHARGE = "MonthlyCharges"


def pricing_data(df: DataFrame) -> DataFrame:
    """Id, price features and charge of customers with internet; an unknown service counts.

    A customer without a charge fails the query that reads the charge.
    """
    require_columns(df, "InternetService", CHARGE, *PRICE_FEATURES)
    offline = F.col("InternetService").eqNullSafe(F.lit("No"))
    charge = number(df, CHARGE).cast("double")
    known = guarded(charge, charge.isNull(), "customers to price must have a charge")
    return df.filter(~offline).select(ID, *PRICE_FEATURES, known.alias(CHARGE))


def split_pricing(data: DataFrame, seed: int = SEED) -> DataFrame:
    """Column part: 80 % train, 20 % test."""
    return assign(data, "part", holdout_sizes, stratum=None, seed=seed)


def bundles(data: DataFrame) -> DataFrame:
    """One row per combination of service levels: n and the charge total.

    This is all that the regression needs of the rows, and it is pre-aggregated where they lie.
    """
    return data.groupBy(*PRICE_FEATURES).agg(F.count("*").alias("n"), F.sum(CHARGE).alias("total"))


def _levels() -> Column:
    """The levels a bundle has, as column_level names."""
    named = [F.concat_ws("_", F.lit(c), F.coalesce(F.col(c), F.lit("nan"))) for c in PRICE_FEATURES]
    return F.array(*named)


def cross_products(bundled: DataFrame) -> DataFrame:
    """(a, b, n, total): customers that have both level a and level b, and what they pay.

    Each bundle spans its own 12 x 12 level pairs and is summed away at once, so what is
    shuffled is at most one row per pair of levels and task.
    """
    levels = bundled.select("n", "total", _levels().alias("levels"))
    left = levels.select("n", "total", "levels", F.explode("levels").alias("a"))
    pairs = left.select("n", "total", "a", F.explode("levels").alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def gramian(bundled: DataFrame) -> DataFrame:
    """(a, b, n): customers that have both level a and level b."""
    return cross_products(bundled).select("a", "b", "n")


def moments(bundled: DataFrame) -> DataFrame:
    """(level, n, total): customers with a level and what they pay."""
    rows = bundled.select("n", "total", F.explode(_levels()).alias("level"))
    return rows.groupBy("level").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@dataclass(frozen=True)
class PriceModel:
    intercept: float
    coefficients: dict[tuple[str, str], float]

    def price(self) -> Column:
        """Charge of a row's bundle; a level that was never seen adds nothing."""
        parts = []
        for column in PRICE_FEATURES:
            value = F.lit(0.0)
            filled = F.coalesce(F.col(column), F.lit("nan"))
            for (name, level), coefficient in self.coefficients.items():
                if name == column:
                    value = F.when(filled == level, F.lit(coefficient)).otherwise(value)
            parts.append(value)
        return reduce(add, parts) + F.lit(self.intercept)


def fit_price_model(train: DataFrame) -> PriceModel:
    """Minimum-norm least squares on centred one-hot columns.

    Spark sums the cross products in one aggregation; the driver sees one matrix over the service
    levels, of which there are a few dozen. Its diagonal holds the counts and totals of single levels.
    One-hot columns are linearly dependent, which the pseudo-inverse resolves.
    """
    products = cross_products(bundles(train)).collect()
    sums = {row["a"]: (row["n"], row["total"]) for row in products if row["a"] == row["b"]}
    if not sums:
        raise ValueError("no customers with internet to price")
    names = sorted(sums)
    where = {name: i for i, name in enumerate(names)}
    cross = np.zeros((len(names), len(names)))
    for row in products:
        cross[where[row["a"]], where[row["b"]]] = row["n"]
    # Every row has exactly one level per feature.
    first = [name for name in names if name.startswith(f"{PRICE_FEATURES[0]}_")]
    n = sum(sums[name][0] for name in first)
    mean_y = sum(sums[name][1] for name in first) / n
    mean_x = np.array([sums[name][0] for name in names]) / n
    xy = np.array([sums[name][1] for name in names])
    centred = cross - n * np.outer(mean_x, mean_x)
    beta = np.linalg.pinv(centred, rcond=1e-10, hermitian=True) @ (xy - n * mean_x * mean_y)
    coefficients = {tuple(name.split("_", 1)): float(b) for name, b in zip(names, beta, strict=True)}
    return PriceModel(float(mean_y - mean_x @ beta), coefficients)


def train_price_model(data: DataFrame, seed: int = SEED) -> tuple[PriceModel, DataFrame]:
    """The model from 80 % of the rows, and its r2 on the others as one row."""
    split = split_pricing(data, seed)
    model = fit_price_model(split.filter(F.col("part") == "train"))
    held = split.filter(F.col("part") == "test")
    return model, r2(held.withColumn("predicted", model.price()), CHARGE, "predicted")


def coefficient_table(spark: SparkSession, model: PriceModel) -> DataFrame:
    rows = [(c, level, b) for (c, level), b in model.coefficients.items()]
    return spark.createDataFrame(rows, "tjanst string, varde string, koefficient double")


def price_list(spark: SparkSession, model: PriceModel) -> DataFrame:
    """(tjanst, USD_per_manad): span between a service's dearest and cheapest level."""
    span = F.max("koefficient") - F.min("koefficient")
    spans = coefficient_table(spark, model).groupBy("tjanst").agg(span.alias("USD_per_manad"))
    return spans.orderBy(F.desc("USD_per_manad"), "tjanst")


def flag_unseen(quotes: DataFrame, observed: DataFrame) -> DataFrame:
    """Quotes with extrapolated = no observed customer has that internet and phone service."""
    pair = ["InternetService", "PhoneService"]
    seen = observed.select(*pair).distinct().withColumn("_seen", F.lit(True))
    marked = quotes.join(seen, pair, "left")
    return marked.withColumn("extrapolated", F.col("_seen").isNull()).drop("_seen")


def price_quotes(quotes: DataFrame, model: PriceModel, observed: DataFrame) -> DataFrame:
    """Monthly price and extrapolation flag for a table of service bundles."""
    require_columns(quotes, *PRICE_FEATURES)
    return flag_unseen(quotes, observed).withColumn("manadspris", model.price())
