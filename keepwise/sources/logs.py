"""Append-only run and prediction logs, the results document and held-out predictions."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.functions.features import decision
from keepwise.operators.quality import require_columns
from keepwise.schema import ID, PROBABILITY, RAW_FEATURES

RUN_SCHEMA = (
    "created_at string, id int, model_name string, stage string, "
    "best_params map<string,string>, metrics map<string,double>"
)
RESULTS_SCHEMA = (
    "created_at string, random_state int, cv_folds int, scoring string, selection_metric string, "
    "split struct<n_train:bigint,n_validation:bigint,n_test:bigint>, "
    "models array<struct<model:string,best_params:map<string,string>,cv_roc_auc:double,"
    "validation:struct<accuracy:double,precision:double,recall:double,f1:double,roc_auc:double>>>, "
    "best_model string, "
    "test struct<accuracy:double,precision:double,recall:double,f1:double,roc_auc:double>"
)


def now() -> str:
    return datetime.now().isoformat(timespec="seconds")


def _read(spark: SparkSession, path: str, what: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no {what} at {path}") from error


def log_model_runs(spark: SparkSession, path: str, runs: list[dict], created_at: str | None = None) -> None:
    """Append evaluation runs: model_name, stage, best_params and metrics each."""
    stamp = created_at or now()
    rows = [
        (
            stamp,
            position,
            run["model_name"],
            run["stage"],
            {k: str(v) for k, v in run["best_params"].items()},
            {k: float(v) for k, v in run["metrics"].items()},
        )
        for position, run in enumerate(runs)
    ]
    spark.createDataFrame(rows, RUN_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_model_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs, newest first, with parameters and metrics as JSON text."""
    runs = _read(spark, path, "model runs")
    return runs.withColumns(
        {"best_params": F.to_json("best_params"), "metrics": F.to_json("metrics")}
    ).orderBy(F.desc("created_at"), F.desc("id"))


def prediction_rows(scored: DataFrame, threshold: float, created_at: str | None = None) -> DataFrame:
    """The log rows of a scored table: inputs as JSON, probability, threshold and decision."""
    require_columns(scored, ID, PROBABILITY)
    inputs = [F.col(c) for c in RAW_FEATURES if c in scored.columns]
    # In a stream every micro-batch has its own time.
    clock = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.lit(created_at) if created_at else clock
    return scored.select(
        stamp.alias("created_at"),
        ID,
        F.to_json(F.struct(*inputs)).alias("customer_input"),
        F.col(PROBABILITY).cast("double").alias(PROBABILITY),
        F.lit(float(threshold)).alias("threshold"),
        decision(F.col(PROBABILITY), threshold).alias("predicted_churn"),
    )


def log_predictions(scored: DataFrame, path: str, threshold: float = 0.5, created_at: str | None = None) -> None:
    prediction_rows(scored, threshold, created_at).write.mode("append").parquet(path)


def load_predictions(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The latest predictions; within one append, by descending id."""
    log = _read(spark, path, "predictions")
    return log.orderBy(F.desc("created_at"), F.desc(ID)).limit(limit)


def write_results(spark: SparkSession, path: str, summary: dict) -> None:
    """The nested results document of a training run, one JSON object."""
    models = [
        {**m, "best_params": {k: str(v) for k, v in m["best_params"].items()}} for m in summary["models"]
    ]
    row = {**summary, "models": models}
    spark.createDataFrame([row], RESULTS_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RESULTS_SCHEMA).option("multiLine", True).json(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no results document at {path}") from error


def model_comparison(results: DataFrame) -> DataFrame:
    """One row per model: cross-validated AUC and validation metrics."""
    rows = results.select(F.posexplode("models").alias("position", "m"))
    return rows.orderBy("position").select(
        F.col("m.model").alias("model"), "m.cv_roc_auc", "m.validation.*", "m.best_params"
    )


def write_test_predictions(predictions: DataFrame, path: str) -> None:
    predictions.select(ID, "y_true", PROBABILITY).write.mode("overwrite").parquet(path)


def read_test_predictions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "test predictions")
