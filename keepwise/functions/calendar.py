"""Forecast months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepwise.schema import MONTH_NAMES


def month_label(month: Column) -> Column:
    """'Okt 2026': fixed names, since date_format depends on the locale."""
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    return F.concat_ws(" ", F.element_at(names, F.month(month)), F.year(month).cast("string"))
