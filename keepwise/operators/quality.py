"""Schema checks and data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwise.functions.numbers import number
from keepwise.schema import ID, LEFT, RAW_FEATURES, REQUIRED, STAYED, TARGET, SchemaError


def require_columns(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise KeyError(f"column {name!r} is not in the data")


def check_columns(df: DataFrame, require_target: bool = True) -> None:
    """Raise with every missing column named; looks at the schema only."""
    missing = sorted(set(REQUIRED if require_target else RAW_FEATURES) - set(df.columns))
    if missing:
        raise SchemaError(f"missing columns: {missing}")


def validate(df: DataFrame, require_target: bool = True) -> None:
    """Raise SchemaError when the data cannot be trained or scored on.

    One aggregation covers the emptiness and target checks. ``unexpected_targets`` lists the
    offending values; the message gives the number of them and the smallest and largest.
    """
    if not require_target:
        if df.isEmpty():
            raise SchemaError("the data set is empty")
        return check_columns(df, require_target=False)
    if TARGET not in df.columns:
        if df.isEmpty():
            raise SchemaError("the data set is empty")
        return check_columns(df)
    target = F.col(TARGET)
    unexpected = ~target.isin(STAYED, LEFT)
    found = df.agg(
        F.count("*").alias("rows"),
        F.countDistinct(F.when(unexpected, target)).alias("unexpected"),
        F.min(F.when(unexpected, target)).alias("low"),
        F.max(F.when(unexpected, target)).alias("high"),
        F.count_if(target.isNull()).alias("missing"),
    ).first()
    if found["rows"] == 0:
        raise SchemaError("the data set is empty")
    check_columns(df)
    if found["unexpected"]:
        seen = " to ".join(repr(v) for v in dict.fromkeys([found["low"], found["high"]]))
        raise SchemaError(
            f"{found['unexpected']} unexpected values in {TARGET} ({seen}), see unexpected_targets(); allowed: {[STAYED, LEFT]}"
        )
    if found["missing"]:
        raise SchemaError(f"{TARGET} has missing values")


def unexpected_targets(df: DataFrame) -> DataFrame:
    """(value, n): every target value that is not allowed, null left out."""
    target = F.col(TARGET)
    wrong = df.filter(~target.isin(STAYED, LEFT))
    return wrong.groupBy(target.alias("value")).agg(F.count("*").alias("n")).orderBy("value")


def data_quality(df: DataFrame) -> DataFrame:
    """One row: kunder, unika_id, dubbletter, tomma_totalcharges.

    Equal rows share their id and fingerprint. Ids are shuffled once, to count by (id, fingerprint);
    everything else follows from those counts. Whole rows are only compared where a pair repeats; where
    none does, adaptive execution drops that branch.
    """
    require_columns(df, ID, "TotalCharges")
    marked = df.select("*", F.xxhash64(*df.columns).alias("_print"))
    blank = F.count_if(number(df, "TotalCharges").isNull()).alias("blank")
    pairs = marked.groupBy(ID, "_print").agg(F.count("*").alias("n"), blank)
    per_id = pairs.groupBy(ID).agg(F.sum("n").alias("n"), F.sum("blank").alias("blank"))
    counted = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("kunder"),
        F.count(ID).alias("unika_id"),
        F.coalesce(F.sum("blank"), F.lit(0)).alias("tomma_totalcharges"),
    )
    repeated = pairs.filter("n > 1").select(F.col(ID).alias("_id"), F.col("_print").alias("_p"))
    same = F.col(ID).eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_p"))
    copies = marked.join(repeated, same, "left_semi").groupBy(df.columns).agg(F.count("*").alias("_n"))
    duplicates = copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("dubbletter"))
    # Two relations of one row each.
    both = counted.withColumn("_one", F.lit(1)).join(duplicates.withColumn("_one", F.lit(1)), "_one")
    return both.select("kunder", "unika_id", "dubbletter", "tomma_totalcharges")


def column_profile(df: DataFrame) -> DataFrame:
    """Name, position, type and non-null count of every column, from one aggregation."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("dtype"),
            F.col(field.name).alias("non_null"),
        )
        for position, field in enumerate(df.schema)
    ]
    return counts.select(F.inline(F.array(*rows)))


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for every level of every listed column, NULL included.

    All columns share one scan and one shuffle; partial counts keep the shuffle at the number
    of levels, so a level that holds most of the rows costs no more than any other.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return (
        df.select(F.inline(F.array(*pairs)))
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): the levels of each column, NULL left out, in sorted order."""
    levels = level_counts(df, columns).filter(F.col("value").isNotNull())
    return levels.select("column", "value").orderBy("column", "value")


def categorical_columns(df: DataFrame) -> list[str]:
    """Text columns other than the id and the charge total that arrives as text."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return [c for c in texts if c not in (ID, "TotalCharges")]


def unparseable_rows(df: DataFrame) -> DataFrame:
    """Customers whose TotalCharges is not a number."""
    bad = df.filter(number(df, "TotalCharges").isNull())
    return bad.select(ID, "tenure", "MonthlyCharges", "TotalCharges", TARGET)
