"""Checks that hold whichever column is read, and cases that used to be dropped."""

from __future__ import annotations

from collections import Counter
from datetime import date

import pytest

from conftest import customer_rows
from keepwise.operators import forecast, metrics, pricing, quality
from keepwise.operators.quantiles import exact_quantiles
from keepwise.operators.stages import BalancedWeights
from keepwise.schema import SchemaError


def test_every_figure_carries_its_checks(spark, three):
    wild = three.withColumn("churn_probability", three.churn_probability + 2)
    for column in forecast.kpis(three).columns:
        with pytest.raises(Exception, match="churn_probability"):
            forecast.kpis(wild).select(column).collect()
        with pytest.raises(Exception, match="nobody left"):
            forecast.kpis(three.filter("Churn = 'Yes'")).select(column).collect()
    single = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y_true int, churn_probability double")
    for column in ("accuracy", "precision", "recall", "f1", "roc_auc"):
        with pytest.raises(Exception, match="both classes"):
            metrics.compute_metrics(single).select(column).collect()


def test_cohorts_of_new_groups_count(spark):
    rows = [("a", 100.0, 0.5, "No"), ("b", 50.0, 0.1, "Yes")]
    scored = spark.createDataFrame(rows, "Contract string, MonthlyCharges double, churn_probability double, Churn string")
    base = forecast.revenue_forecast(scored, 3, date(2026, 1, 5), ["Contract"])
    given = [("a", 1, 10, 10.0), ("b", 1, 100, 10.0), (None, 2, 5, 10.0)]
    cohorts = spark.createDataFrame(given, "Contract string, months_ahead int, new_customers int, monthly_charge double")
    found = forecast.with_new_customers(base, cohorts, 0.5, ["Contract"]).collect()
    assert Counter(r.Contract for r in found) == {"a": 4, "b": 4, None: 4}
    at = {(r.Contract, r.months_ahead): r for r in found}
    assert [at["b", m].new_mrr for m in range(4)] == [0, 1000, 500, 250]
    assert [at[None, m].total_mrr for m in range(4)] == [0, 0, 50, 25]
    assert at["b", 2].expected_mrr == 0 and at["b", 2].month_label == at["a", 2].month_label


def test_customers_to_price_need_a_charge(make):
    rows = [{**r, "MonthlyCharges": None if i == 4 else r["MonthlyCharges"]} for i, r in enumerate(customer_rows(12))]
    rows[4]["InternetService"] = "DSL"
    with pytest.raises(Exception, match="must have a charge"):
        pricing.train_price_model(pricing.pricing_data(make(rows)))


def test_all_unexpected_targets_are_listed(make):
    rows = [{**r, "Churn": f"odd {i % 40:02d}"} for i, r in enumerate(customer_rows(60))]
    found = quality.unexpected_targets(make(rows)).collect()
    assert len(found) == 40 and sum(r.n for r in found) == 60
    with pytest.raises(SchemaError, match="40 unexpected values.*odd 00.*odd 39"):
        quality.validate(make(rows))


def test_class_weights_of_the_stage(spark):
    rows = spark.createDataFrame([(1.0,), (0.0,), (0.0,), (0.0,), (None,)], "label double")
    weighted = {(r.label, r.weight) for r in BalancedWeights().fit(rows).transform(rows).collect()}
    assert weighted == {(1.0, 2.0), (0.0, 4 / 6), (None, None)}
    with pytest.raises(ValueError, match="neither 0 nor 1"):
        BalancedWeights().fit(spark.createDataFrame([(1.0,), (2.0,)], "label double"))


def test_quantiles_are_the_same_with_and_without_narrowing(spark):
    df = spark.range(3000).selectExpr("cast(pmod(xxhash64(id), 1000) as double) as x", "cast(id % 3 as double) as y")
    columns = {"x": df.x, "y": df.y}
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    assert exact_quantiles(df, columns, probs) == exact_quantiles(df, columns, probs, small=20)
