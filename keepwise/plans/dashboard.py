"""The revenue dashboard as one plan over a scored customer table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame

from keepwise.operators.forecast import (
    group_breakdown,
    kpis,
    revenue_forecast,
    risk_cards,
    with_new_customers,
)
from keepwise.operators.prepare import filter_customers


@dataclass(frozen=True)
class Dashboard:
    kpis: DataFrame
    forecast: DataFrame
    breakdown: DataFrame
    cards: DataFrame


def dashboard(
    scored: DataFrame,
    cohorts: DataFrame,
    filters: dict[str, list] | None = None,
    months: int = 12,
    group_column: str = "Contract",
    start: date | None = None,
) -> Dashboard:
    """Filtered headline figures, forecast with new customers, and group cards.

    ``scored`` should be a stored table: its four readers then scan only their own columns.
    New customers leave at the mean risk of the filtered active customers.
    """
    selected = filter_customers(scored, filters or {})
    numbers = kpis(selected)
    risk = numbers.select("predicted_churn_rate").scalar()
    forecast = with_new_customers(revenue_forecast(selected, months, start), cohorts, risk)
    return Dashboard(
        numbers, forecast, group_breakdown(selected, group_column), risk_cards(selected, group_column)
    )
