"""Tables that several queries read, written once per application to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.functions import features as X
from keepwise.operators.prepare import with_churn_flag
from keepwise.plans.training import Training, train
from keepwise.schema import PROBABILITY
from keepwise.session import table_path, write_table
from keepwise.sources.subscribers import subscribers

RATE_KEYS = ["Contract", "PaymentMethod"]

_known: dict = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _known:
        _known[key] = build()
    return _known[key]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nothing was written to yet, for appending sinks."""
    return table_path(spark, name, uuid.uuid4().hex)


def customers_path(spark: SparkSession, sf_dir: str) -> str:
    return table_path(spark, "customers", sf_dir)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        return write_table(subscribers(spark, sf_dir), customers_path(spark, sf_dir))

    return once(spark, sf_dir, "customers", build)


def with_group_rate(df: DataFrame, observed: DataFrame) -> DataFrame:
    """Probability = churn share of the customer's contract and payment method."""
    rates = observed.groupBy(*RATE_KEYS).agg(F.avg(X.churn_flag()).alias(PROBABILITY))
    return df.join(rates, RATE_KEYS, "left")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched customers with a probability that plain SQL can reproduce."""

    def build():
        base = customers(spark, sf_dir)
        rated = with_group_rate(with_churn_flag(base), base)
        return write_table(rated, table_path(spark, "scored", sf_dir))

    return once(spark, sf_dir, "scored", build)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customerID, y_true, churn_probability)."""
    return scored(spark, sf_dir).select("customerID", F.col("churn_flag").cast("int").alias("y_true"), PROBABILITY)


def trained(spark: SparkSession, sf_dir: str) -> Training:
    return once(spark, sf_dir, "trained", lambda: train(customers(spark, sf_dir)))
