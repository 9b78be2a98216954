"""Stages, search, scoring, importance, persistence, logs, training and streaming."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from conftest import customer_rows
from keepwise.operators import models as md
from keepwise.operators import prepare
from keepwise.operators.stages import BalancedWeights, ModeImputer, NumericScaler
from keepwise.plans import training
from keepwise.schema import ID, NUMERIC, PROBABILITY, TARGET, SchemaError
from keepwise.sources import customers as source
from keepwise.sources import logs
from keepwise.streaming.scoring import score_stream


def family(name, **grid):
    original = next(c for c in md.candidates() if c.name == name)
    return md.Candidate(name, original.build, {k: grid.get(k, v[:1]) for k, v in original.grid.items()})


LOGISTIC = family("Logistisk regression", C=[1])


@pytest.fixture(scope="module")
def features(raw):
    return prepare.features_with_label(raw).cache()


@pytest.fixture(scope="module")
def fitted(features):
    return md.fit_pipelines(features, [(LOGISTIC, {"C": 1})])[0]


@pytest.fixture(scope="module")
def customers(raw):
    return raw.drop(TARGET)


def probabilities(df):
    return {r[ID]: r[PROBABILITY] for r in df.collect()}


def vector(model, df):
    stages = PipelineModel(model.stages[:-2])
    return stages.transform(prepare.prepare_features(df)).select(vector_to_array("features")).first()[0]


def test_scaler_imputes_the_median_and_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (4.0, 5), (None, 5), (9.0, None)], "a double, b int")
    model = NumericScaler(inputCols=["a", "b"], outputCols=["x", "y"]).fit(df)
    out = [r["x"] for r in model.transform(df).collect()]
    filled = np.array([1.0, 2.0, 4.0, 3.0, 9.0])
    assert out == pytest.approx(list((filled - filled.mean()) / filled.std()))
    assert [r["y"] for r in model.transform(df).collect()] == [0.0] * 5


def test_mode_imputer_takes_the_lowest_of_several(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,), ("c",)], "t string")
    model = ModeImputer(inputCols=["t"], outputCols=["f"]).fit(df)
    assert [r["f"] for r in model.transform(df).collect()][4] == "a"


def test_weights_are_skipped_without_label(spark, features):
    model = BalancedWeights(labelCol="label", weightCol="weight").fit(features.filter("label = 1 or tenure > 20"))
    assert "weight" in model.transform(features).columns
    assert "weight" not in model.transform(features.drop("label")).columns


def test_vector_layout(fitted, raw, make):
    names = md.feature_names(fitted)
    assert names[: len(NUMERIC)] == NUMERIC and "Contract_Month-to-month" in names
    means = (
        PipelineModel(fitted.stages[:-2])
        .transform(prepare.prepare_features(raw))
        .select(F.posexplode(vector_to_array("features")).alias("i", "v"))
        .groupBy("i")
        .agg(F.avg("v").alias("m"))
        .filter(F.col("i") < len(NUMERIC))
    )
    assert [r["m"] for r in means.collect()] == pytest.approx([0.0] * len(NUMERIC), abs=1e-9)

    def contract_entries(**values):
        row = {**customer_rows(1)[0], **values}
        return [v for n, v in zip(names, vector(fitted, make([row])), strict=True) if n.startswith("Contract_")]

    assert contract_entries(Contract="Fyraårsavtal") == [0.0, 0.0, 0.0]
    assert sum(contract_entries(Contract=None)) == 1.0
    assert np.isfinite(vector(fitted, make([{**customer_rows(1)[0], "TotalCharges": " "}]))).all()


def test_logistic_regression_has_the_stated_objective(features):
    """C * sum(w * loss) + |b|^2 / 2, intercept free: the gradient vanishes at the solution."""
    model = md.fit_pipelines(features, [(LOGISTIC, {"C": 1})])[0]
    rows = (
        PipelineModel(model.stages[:-1])
        .transform(features)
        .select(vector_to_array("features").alias("x"), "label", "weight")
        .collect()
    )
    x = np.array([r["x"] for r in rows])
    y = np.array([r["label"] for r in rows])
    w = np.array([r["weight"] for r in rows])
    beta, intercept = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    residual = w * (1 / (1 + np.exp(-(x @ beta + intercept))) - y)
    assert np.abs(x.T @ residual + beta).max() < 0.02
    assert abs(residual.sum()) < 0.02


def test_scoring(fitted, customers, raw, make):
    scored = probabilities(md.predict_proba(fitted, customers))
    assert len(scored) == 60 and all(0 <= p <= 1 for p in scored.values())
    assert probabilities(md.predict_proba(fitted, raw)) == pytest.approx(scored)
    turned = customers.select(*reversed(customers.columns)).withColumn("extra", F.lit(1))
    out = md.predict_proba(fitted, turned)
    assert out.columns == [*turned.columns, PROBABILITY]
    assert probabilities(out) == pytest.approx(scored)
    with pytest.raises(SchemaError, match="Contract"):
        md.predict_proba(fitted, customers.drop("Contract"))
    with pytest.raises(SchemaError, match="empty"):
        md.predict_proba(fitted, customers.limit(0), check_empty=True)
    odd = [{**customer_rows(1)[0], **v} for v in ({"PaymentMethod": "in shells"}, {"TotalCharges": None}, {"TotalCharges": " "})]
    assert all(0 <= r[PROBABILITY] <= 1 for r in md.predict_proba(fitted, make(odd)).collect())
    decided = md.score_batch(fitted, customers, 0.5)
    ranked = [r[PROBABILITY] for r in md.rank_by_risk(decided).collect()]
    assert ranked == sorted(ranked, reverse=True)
    count = md.flagged_count(decided).first()
    assert (count["flaggade"], count["kunder"]) == (sum(p >= 0.5 for p in scored.values()), 60)


def test_save_and_load(spark, fitted, customers, tmp_path):
    path = md.save_model(fitted, str(tmp_path / "nested" / "model"))
    loaded = md.load_model(spark, path)
    assert probabilities(md.predict_proba(loaded, customers)) == probabilities(md.predict_proba(fitted, customers))
    with pytest.raises(FileNotFoundError, match="nothing saved"):
        md.load_model(spark, str(tmp_path / "none"))


def test_candidates():
    families = {c.name: c for c in md.candidates()}
    assert {n: len(c.settings()) for n, c in families.items()} == {
        "Logistisk regression": 4,
        "Beslutsträd": 9,
        "Random forest": 16,
    }
    for c in families.values():
        assert c.build(c.settings()[0], 100).getWeightCol() == "weight"


def test_importance(spark, features, fitted):
    table = md.feature_importance(spark, fitted).collect()
    sizes = [abs(r["value"]) for r in table]
    assert {r["kind"] for r in table} == {"coefficient"} and sizes == sorted(sizes, reverse=True)
    assert len(table) == len(md.feature_names(fitted))
    forest = family("Random forest", n_estimators=[5])
    model = md.fit_pipelines(features, [(forest, forest.settings()[0])])[0]
    table = md.feature_importance(spark, model)
    assert {r["kind"] for r in table.collect()} == {"importance"}
    assert table.agg(F.sum("value")).first()[0] == pytest.approx(1.0)
    assert md.top_features(table, 5).count() == 5
    with pytest.raises(ValueError, match="no column weights"):
        md.feature_importance(spark, PipelineModel([*fitted.stages[:-1], object()]))


def test_select_best():
    results = [
        {"model": m, "validation": {"roc_auc": a}} for m, a in [("a", 0.7), ("b", 0.8), ("c", 0.8)]
    ]
    assert training.select_best(results)["model"] == "b"


@pytest.fixture(scope="module")
def job(spark, raw, tmp_path_factory):
    folder = tmp_path_factory.mktemp("job")
    csv = source.export_csv(raw, str(folder / "raw"))
    families = [family("Logistisk regression", C=[0.1, 1.0]), family("Beslutsträd")]
    summary = training.run(spark, csv, str(folder), families, folds=3)
    return folder, summary, families


def test_training_job_writes_everything(spark, job):
    folder, summary, _ = job
    assert summary["split"] == {"n_train": 36, "n_validation": 12, "n_test": 12}
    document = logs.read_results(spark, str(folder / "results")).first()
    assert document["best_model"] == summary["best_model"]
    assert set(document["test"].asDict()) == {"accuracy", "precision", "recall", "f1", "roc_auc"}
    comparison = logs.model_comparison(logs.read_results(spark, str(folder / "results"))).collect()
    assert [r["model"] for r in comparison] == ["Logistisk regression", "Beslutsträd"]
    held = logs.read_test_predictions(spark, str(folder / "test_predictions"))
    assert held.columns == [ID, "y_true", PROBABILITY] and held.count() == 12
    stages = [r["stage"] for r in logs.load_model_runs(spark, str(folder / "model_runs")).collect()]
    assert stages == ["test", "validation", "validation"]
    model = md.load_model(spark, str(folder / "model"))
    assert md.predict_proba(model, source.load(spark, str(folder / "customers"))).count() == 60


def test_training_is_deterministic(spark, job, raw):
    _, summary, families = job
    assert training.train(raw, families, folds=3).summary["test"] == pytest.approx(summary["test"])


def test_training_rejects_bad_data(spark, raw, tmp_path):
    with pytest.raises(ValueError, match="single class"):
        training.train(raw.withColumn(TARGET, F.lit("No")), [LOGISTIC])
    with pytest.raises(SchemaError, match="tenure"):
        training.train(raw.drop("tenure"), [LOGISTIC])
    with pytest.raises(FileNotFoundError):
        training.run(spark, str(tmp_path / "none.csv"), str(tmp_path / "job"), [LOGISTIC])


def test_prediction_log(spark, raw, tmp_path):
    path = str(tmp_path / "log")
    with pytest.raises(FileNotFoundError):
        logs.load_predictions(spark, path)
    scored = raw.limit(5).withColumn(PROBABILITY, F.lit(0.42))
    logs.log_predictions(scored, path, 0.5, "2026-01-01T00:00:00")
    logs.log_predictions(scored, path, 0.3, "2026-01-02T00:00:00")
    rows = logs.load_predictions(spark, path, 7).collect()
    assert [r["predicted_churn"] for r in rows] == [1] * 5 + [0] * 2
    assert "tenure" in json.loads(rows[0]["customer_input"])
    with pytest.raises(ValueError, match=r"\[0, 1\]"):
        logs.log_predictions(scored, path, 1.2)


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "runs")
    run = {"model_name": "a model", "stage": "validation", "best_params": {"C": 1}, "metrics": {"recall": 0.8}}
    logs.log_model_runs(spark, path, [run])
    row = logs.load_model_runs(spark, path).first()
    assert row["model_name"] == "a model"
    assert json.loads(row["metrics"]) == {"recall": 0.8} and json.loads(row["best_params"]) == {"C": "1"}


def test_stream_scores_each_row_once(spark, raw, fitted, tmp_path):
    arriving, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    raw.filter(f"{ID} < 'sub-00082'").repartition(3).write.parquet(arriving)

    def run():
        score_stream(
            spark, arriving, raw.schema, lambda df: md.predict_proba(fitted, df), sink, state, 0.5, files_per_trigger=1
        ).awaitTermination()
        return spark.read.parquet(sink)

    assert run().count() == 30
    raw.filter(f"{ID} >= 'sub-00082'").write.mode("append").parquet(arriving)
    run()
    logged = run()
    assert logged.count() == 60 and logged.select(ID).distinct().count() == 60
    batch = md.score_batch(fitted, raw, 0.5)
    assert probabilities(logged) == pytest.approx(probabilities(batch))
