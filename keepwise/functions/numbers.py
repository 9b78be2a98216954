"""Text to number, with bad text as NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A plain decimal number; try_cast alone would also take '12d', '0x1p3', 'NaN' and 'inf'.
DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_number(text: Column) -> Column:
    return F.when(text.rlike(DECIMAL_TEXT), F.trim(text).try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a number whatever its stored type; NaN becomes NULL."""
    dtype = df.schema[name].dataType
    column = F.col(name)
    if isinstance(dtype, T.StringType):
        return parse_number(column)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    if isinstance(dtype, T.DecimalType):
        return column.cast("double")
    return column


def guarded(value: Column, bad: Column, message: str) -> Column:
    """``value``, or a query error where ``bad`` holds: a check that costs no extra scan."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)
