"""The customer table: CSV in, validated Parquet table, scans, CSV out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwise.functions.numbers import number
from keepwise.operators.quality import validate
from keepwise.schema import CUSTOMER_TYPES, ID, MISSING_TEXT


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Scan a customer CSV with every column as text, bound by header name.

    ``enforceSchema`` is off so that several files with differing headers fail instead of
    having their values swapped. ``multiline`` allows line breaks inside quotes, at the
    price of one task per file.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
    try:
        raw = reader.option("enforceSchema", False).csv(path)
    except AnalysisException as error:
        if _missing(error):
            raise FileNotFoundError(f"no data file at {path}") from error
        raise
    return raw.select(
        [F.when(~F.col(f"`{c}`").isin(MISSING_TEXT), F.col(f"`{c}`")).alias(c) for c in raw.columns]
    )


def typed(df: DataFrame) -> DataFrame:
    """Cast by name to the stored types; other columns pass through.

    A whole-number column that holds fractions is stored as double instead of being cut off.
    """
    pending = {
        name: dtype
        for name, dtype in CUSTOMER_TYPES.items()
        if name in df.columns and df.schema[name].dataType != dtype
    }
    whole = [name for name, dtype in pending.items() if isinstance(dtype, T.IntegerType)]
    if whole:
        values = {name: number(df, name) for name in whole}
        fractions = df.agg(*[F.count_if(v != F.floor(v)).alias(name) for name, v in values.items()]).first()
        pending.update({name: T.DoubleType() for name in whole if fractions[name]})
    casts = {
        name: (F.col(name) if isinstance(dtype, T.StringType) else number(df, name)).cast(dtype)
        for name, dtype in pending.items()
    }
    return df.withColumns(casts) if casts else df


def ingest(spark: SparkSession, csv_path: str, table: str) -> str:
    """Build or replace the customer table from a CSV after validating it."""
    raw = read_csv(spark, csv_path)
    validate(raw)
    typed(raw).write.mode("overwrite").parquet(table)
    return table


def load(spark: SparkSession, table: str) -> DataFrame:
    try:
        return spark.read.parquet(table)
    except AnalysisException as error:
        if _missing(error):
            raise FileNotFoundError(f"no customer table at {table}; build it with ingest()") from error
        raise


def load_or_ingest(spark: SparkSession, csv_path: str, table: str) -> DataFrame:
    """The customer table, built from the CSV first when it does not exist yet."""
    try:
        return load(spark, table)
    except FileNotFoundError:
        return load(spark, ingest(spark, csv_path, table))


def export_csv(df: DataFrame, path: str) -> str:
    """Write rows as CSV, blanks kept as they are."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    for side in ("ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"):
        writer = writer.option(side, False)
    writer.csv(path)
    return path


def preview(df: DataFrame, rows: int = 200) -> DataFrame:
    """The first rows by customer id."""
    return df.orderBy(ID).limit(rows)
