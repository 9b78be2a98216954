"""Derived customer columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepwise.schema import ADDON_SERVICES, LEFT, PRICE_BINS, STAYED, TARGET, TENURE_BINS


def addon_count() -> Column:
    """How many of the six add-on services the customer has."""
    has = [F.coalesce((F.col(c) == "Yes").cast("int"), F.lit(0)) for c in ADDON_SERVICES]
    return reduce(add, has)


def average_charge(total: Column, tenure: Column) -> Column:
    """Total paid per month of tenure; NULL for customers without a billed month."""
    return F.when(tenure > 0, total / tenure)


def _band(value: Column, bins, pick) -> Column:
    lowest = bins[0][0]
    out = F.when(value <= lowest, None)
    for position, (_, upper, label) in enumerate(bins):
        hit = value.isNotNull() if upper is None else value <= upper
        out = out.when(hit, F.lit(pick(position, label)))
    return out


def tenure_group(tenure: Column) -> Column:
    return _band(tenure, TENURE_BINS, lambda _, label: label)


def price_band(charge: Column) -> Column:
    return _band(charge, PRICE_BINS, lambda _, label: label)


def price_band_order(charge: Column) -> Column:
    return _band(charge, PRICE_BINS, lambda position, _: position)


def churn_flag() -> Column:
    """1.0 for customers who left, 0.0 for all others, a missing target included."""
    return F.coalesce((F.col(TARGET) == LEFT).cast("double"), F.lit(0.0))


def binary_label() -> Column:
    """1.0 / 0.0 for the two target levels, NULL for anything else."""
    return F.when(F.col(TARGET) == LEFT, 1.0).when(F.col(TARGET) == STAYED, 0.0)


def decision(probability: Column, threshold: float) -> Column:
    """1 where the probability reaches the threshold."""
    check_threshold(threshold)
    return (probability >= F.lit(float(threshold))).cast("int")


def check_range(name: str, value: float, low: float, high: float = float("inf")) -> None:
    """Reject a parameter outside [low, high]."""
    if value < low or value > high or value != value:
        bounds = f"at least {low:g}" if high == float("inf") else f"in [{low:g}, {high:g}]"
        raise ValueError(f"{name} must be {bounds}: {value}")


def check_threshold(threshold: float) -> None:
    check_range("threshold", threshold, 0, 1)


def risk_band(rate: Column) -> Column:
    return F.when(rate >= 0.30, "red").when(rate >= 0.15, "orange").when(rate.isNotNull(), "green")
