"""Cleaning, derived features, targets and filters."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.functions import features as X
from keepwise.functions.numbers import number
from keepwise.operators.quality import require_columns
from keepwise.schema import FEATURES, ID, LABEL, RAW_NUMERIC, STAYED, TARGET


def clean(df: DataFrame) -> DataFrame:
    """Make the raw numeric columns that are present numeric; bad text becomes NULL."""
    return df.withColumns({c: number(df, c) for c in RAW_NUMERIC if c in df.columns})


def add_features(df: DataFrame) -> DataFrame:
    """Add num_addon_services, avg_monthly_charge and tenure_group to cleaned rows."""
    tenure = F.col("tenure")
    return df.withColumns(
        {
            "num_addon_services": X.addon_count(),
            "avg_monthly_charge": X.average_charge(F.col("TotalCharges"), tenure),
            "tenure_group": X.tenure_group(tenure),
        }
    )


def enrich(df: DataFrame) -> DataFrame:
    return add_features(clean(df))


def with_churn_flag(df: DataFrame) -> DataFrame:
    """Cleaned and enriched rows with a 0/1 column churn_flag.

    Not "churn": Spark compares names without case, so that would overwrite the target.
    """
    return enrich(df).withColumn("churn_flag", X.churn_flag())


def prepare_features(df: DataFrame) -> DataFrame:
    """The id (when there is one) and exactly the model's feature columns, in order."""
    keys = [ID] if ID in df.columns else []
    return enrich(df).select(*keys, *FEATURES)


def features_with_label(df: DataFrame) -> DataFrame:
    return enrich(df).select(ID, *FEATURES, X.binary_label().alias(LABEL))


def filter_customers(
    df: DataFrame, filters: dict[str, list], require_match: bool = True
) -> DataFrame:
    """AND across columns, OR within a column; an empty list does not filter.

    A filter that leaves nobody is an error; ``require_match=False`` (as for streams) skips that job.
    """
    require_columns(df, *filters)
    tests = [F.col(c).isin(list(values)) for c, values in filters.items() if values]
    kept = df.filter(reduce(and_, tests)) if tests else df
    if tests and require_match and not df.isStreaming and kept.isEmpty():
        raise ValueError("the filter matches no customers")
    return kept


def active_customers(df: DataFrame) -> DataFrame:
    require_columns(df, TARGET)
    return df.filter(F.col(TARGET) == STAYED)
