"""Incremental scoring of arriving customer rows into the prediction log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keepwise.sources.logs import prediction_rows


def score_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    score: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    threshold: float = 0.5,
    created_at: str | None = None,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Score the Parquet files that arrived in ``source`` since the last run, then stop.

    ``score`` adds churn_probability to the rows and must be stateless. The checkpoint records
    which files are done, so a restarted job neither skips nor repeats a row in the log.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = prediction_rows(score(reader.parquet(source)), threshold, created_at)
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
