"""Descriptive aggregates and exact quantiles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import customer_rows
from keepwise.operators import eda
from keepwise.operators.quantiles import exact_quantiles
from keepwise.schema import EDA_CATEGORIES, NUMERIC


def test_churn_rates_cover_everybody(raw):
    for column in EDA_CATEGORIES:
        rates = eda.churn_rate_by(raw, column).collect()
        assert sum(r["antal_kunder"] for r in rates) == 60
        shares = [r["churn_andel"] for r in rates]
        assert shares == sorted(shares, reverse=True)
    with pytest.raises(KeyError, match="hittepå"):
        eda.churn_rate_by(raw, "hittepå")
    assert {r["snitt"] for r in eda.churn_rate_with_mean(raw, "Contract").collect()} == {0.5}


def test_missing_group_keys_are_left_out(make):
    rows = customer_rows()
    rows[0]["Contract"] = None
    assert sum(r["antal_kunder"] for r in eda.churn_rate_by(make(rows), "Contract").collect()) == 59


def test_price_bands_in_order(raw):
    bands = eda.churn_rate_by_price_band(raw).collect()
    names = [r["prisintervall"] for r in bands]
    assert names == [n for n in ["18-30", "30-50", "50-70", "70-90", "90-110", "110-130"] if n in names]
    assert sum(r["antal_kunder"] for r in bands) == 60
    with pytest.raises(KeyError, match="MonthlyCharges"):
        eda.churn_rate_by_price_band(raw.drop("MonthlyCharges"))


def test_correlations_are_pairwise_complete(make):
    rows = customer_rows()
    rows[3]["TotalCharges"] = " "
    df = make(rows)
    found = {r["kolumn"]: r["korrelation"] for r in eda.churn_correlations(df).collect()}
    assert set(found) == set(NUMERIC)
    kept = [r for i, r in enumerate(rows) if i != 3]
    total = [float(r["TotalCharges"]) for r in kept]
    flag = [r["Churn"] == "Yes" for r in kept]
    assert found["TotalCharges"] == pytest.approx(np.corrcoef(total, flag)[0, 1])
    matrix = {(r["a"], r["b"]): r["r"] for r in eda.correlation_matrix(df).collect()}
    tenure = [r["tenure"] for r in kept]
    assert matrix[("tenure", "TotalCharges")] == pytest.approx(np.corrcoef(tenure, total)[0, 1])
    assert matrix[("TotalCharges", "tenure")] == matrix[("tenure", "TotalCharges")]
    assert len(matrix) == 36


def test_describe_matches_numpy(raw):
    row = eda.describe(raw, ["MonthlyCharges"]).first()
    values = np.array([r["MonthlyCharges"] for r in customer_rows()])
    assert row["mean"] == pytest.approx(values.mean())
    assert row["std"] == pytest.approx(values.std(ddof=1))
    assert [row["25%"], row["50%"], row["75%"]] == pytest.approx(list(np.percentile(values, [25, 50, 75])))


def test_class_histogram_matches_numpy(raw):
    for column in ("tenure", "MonthlyCharges"):
        rows = eda.class_histogram(raw, column).collect()
        for churn in (0, 1):
            values = [r[column] for r in customer_rows() if (r["Churn"] == "Yes") == bool(churn)]
            counts, _ = np.histogram(values, bins=30)
            assert [r["antal"] for r in rows if r["churn"] == churn] == list(counts)


@pytest.mark.parametrize("small", [1_000_000, 50])
def test_exact_quantiles_in_both_regimes(spark, small):
    """With a third of the rows on one value and heavy outliers, narrowing stays exact."""
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(4000, 7.25), rng.normal(0, 1e6, 4000), rng.uniform(0, 10, 4001)])
    df = spark.createDataFrame([(float(v), float(i)) for i, v in enumerate(values)], "v double, w double")
    df = df.union(df.limit(5).select(F.lit(None).cast("double"), F.lit(None).cast("double")))
    probs = [0.0, 0.1, 0.25, 0.5, 0.501, 0.75, 1.0]
    found = exact_quantiles(df, {"v": F.col("v"), "w": F.col("w"), "none": F.lit(None).cast("double")}, probs, small)
    assert found["v"] == pytest.approx(list(np.quantile(values, probs)))
    assert found["w"] == pytest.approx(list(np.quantile(np.arange(len(values)), probs)))
    assert found["none"] == [None] * len(probs)


def test_medians_and_deviation(make):
    rows = customer_rows(4)
    for row, (charge, total, tenure) in zip(
        rows, [(1.0, "1", 1), (2.0, "8", 2), (3.0, "9", 3), (4.0, " ", 0)], strict=True
    ):
        row.update(MonthlyCharges=charge, TotalCharges=total, tenure=tenure)
    assert [r["median"] for r in eda.medians(make(rows), ["MonthlyCharges", "TotalCharges"]).collect()] == [2.5, 8.0]
    assert eda.charge_deviation(make(rows)).first()["share_above_limit"] == 0.25
