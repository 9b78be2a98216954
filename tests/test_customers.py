"""Reading, validating, cleaning and deriving."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import customer_rows
from keepwise.functions.features import price_band, risk_band, tenure_group
from keepwise.functions.numbers import parse_number
from keepwise.operators import prepare, quality
from keepwise.schema import ADDON_SERVICES, FEATURES, ID, MISSING_TEXT, REQUIRED, TARGET, SchemaError
from keepwise.sources import customers as source


def changed(make, index=0, **values):
    rows = customer_rows()
    rows[index].update(values)
    return make(rows)


def write_csv(path, rows, columns=REQUIRED):
    text = [",".join(columns), *[",".join("" if r[c] is None else str(r[c]) for c in columns) for r in rows]]
    path.write_text("\n".join(text) + "\n", encoding="utf-8")
    return str(path)


def test_csv_binds_by_name_and_ingest_is_idempotent(spark, tmp_path, raw):
    rows = customer_rows()
    rows[0]["TotalCharges"] = " "
    path = write_csv(tmp_path / "c.csv", rows, list(reversed(REQUIRED)))
    table = str(tmp_path / "table")
    for _ in range(2):
        source.ingest(spark, path, table)
    loaded = source.load(spark, table)
    assert loaded.count() == 60
    expected = raw.filter(f"{ID} <> 'sub-00064'")
    assert loaded.filter(f"{ID} <> 'sub-00064'").select(REQUIRED).exceptAll(expected).count() == 0
    assert loaded.filter(f"{ID} = 'sub-00064'").first()["TotalCharges"] == " "


def test_csv_missing_text_becomes_null(spark, tmp_path):
    rows = customer_rows(len(MISSING_TEXT))
    for row, text in zip(rows, MISSING_TEXT, strict=True):
        row["gender"] = text
    raw = source.read_csv(spark, write_csv(tmp_path / "c.csv", rows))
    assert raw.filter("gender is not null").count() == 0


def test_csv_files_with_other_headers_fail_instead_of_swapping(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write_csv(folder / "a.csv", customer_rows())
    write_csv(folder / "b.csv", customer_rows(), list(reversed(REQUIRED)))
    with pytest.raises(Exception, match="(?i)header"):
        source.read_csv(spark, str(folder)).collect()


def test_fractions_in_whole_number_columns_are_kept(spark, tmp_path):
    rows = customer_rows(4)
    rows[1]["tenure"] = 12.5
    table = str(tmp_path / "t")
    source.ingest(spark, write_csv(tmp_path / "c.csv", rows), table)
    loaded = source.load(spark, table)
    assert sorted(r["tenure"] for r in loaded.collect()) == sorted(float(r["tenure"]) for r in rows)
    assert loaded.schema["SeniorCitizen"].dataType.simpleString() == "int"


def test_missing_files_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        source.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError, match="ingest"):
        source.load(spark, str(tmp_path / "none"))


def test_table_is_built_when_missing(spark, tmp_path):
    path = write_csv(tmp_path / "c.csv", customer_rows())
    assert source.load_or_ingest(spark, path, str(tmp_path / "t")).count() == 60


def test_export_keeps_blanks(spark, tmp_path, make):
    out = source.export_csv(changed(make, TotalCharges=" "), str(tmp_path / "out"))
    back = source.read_csv(spark, out)
    assert back.filter(f"{ID} = 'sub-00064'").first()["TotalCharges"] == " "


def test_validate_accepts_and_rejects(make, raw):
    quality.validate(raw)
    with pytest.raises(SchemaError, match="empty"):
        quality.validate(raw.limit(0))
    with pytest.raises(SchemaError, match="gender.*tenure"):
        quality.validate(raw.drop("tenure", "gender"))
    with pytest.raises(SchemaError, match=TARGET):
        quality.validate(raw.drop(TARGET))
    with pytest.raises(SchemaError, match="unsure"):
        quality.validate(changed(make, Churn="unsure"))
    with pytest.raises(SchemaError, match="missing values"):
        quality.validate(changed(make, Churn=None))
    quality.validate(raw.drop(TARGET), require_target=False)
    with pytest.raises(SchemaError, match="tenure"):
        quality.validate(raw.drop(TARGET, "tenure"), require_target=False)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("1234.50", 1234.5),
        (" 12 ", 12.0),
        ("-1e3", -1000.0),
        (".5", 0.5),
        (" ", None),
        ("", None),
        ("12 or so", None),
        ("12d", None),
        ("0x1p3", None),
        ("NaN", None),
        ("inf", None),
    ],
)
def test_number_parsing(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(parse_number(F.col("t"))).first()[0] == value


def test_addons_average_and_tenure_groups(spark, make):
    rows = customer_rows(3)
    for row, values in zip(
        rows, [["Yes"] * 6, ["No"] * 6, ["Yes", "Yes", "No", "No internet service", "No", "Yes"]], strict=True
    ):
        row.update(zip(ADDON_SERVICES, values, strict=True))
    rows[0].update(tenure=10, TotalCharges="500")
    rows[1].update(tenure=0, TotalCharges="0")
    out = {r[ID]: r for r in prepare.enrich(make(rows)).collect()}
    assert [out[r[ID]]["num_addon_services"] for r in rows] == [6, 0, 3]
    assert out[rows[0][ID]]["avg_monthly_charge"] == 50.0
    assert out[rows[1][ID]]["avg_monthly_charge"] is None

    edges = [(-1, None), (0, "0-12"), (12, "0-12"), (13, "13-24"), (24, "13-24"), (48, "25-48"), (49, "49+"), (None, None)]
    df = spark.createDataFrame(edges, "t int, e string")
    assert df.filter(~tenure_group(F.col("t")).eqNullSafe(F.col("e"))).count() == 0


def test_bands(spark):
    prices = [(0.0, None), (0.1, "18-30"), (30.0, "18-30"), (30.1, "30-50"), (110.0, "90-110"), (130.0, "110-130"), (130.1, None)]
    df = spark.createDataFrame(prices, "p double, e string")
    assert df.filter(~price_band(F.col("p")).eqNullSafe(F.col("e"))).count() == 0
    rates = [(0.3, "red"), (0.29, "orange"), (0.15, "orange"), (0.14, "green")]
    df = spark.createDataFrame(rates, "p double, e string")
    assert df.filter(risk_band(F.col("p")) != F.col("e")).count() == 0


def test_features_and_labels(raw):
    assert prepare.prepare_features(raw).columns == [ID, *FEATURES]
    assert {r[0] for r in prepare.features_with_label(raw).select("label").distinct().collect()} == {0.0, 1.0}
    flagged = prepare.with_churn_flag(raw)
    assert TARGET in flagged.columns
    assert flagged.agg(F.sum("churn_flag")).first()[0] == 30


def test_filters(raw):
    assert prepare.filter_customers(raw, {}).count() == 60
    assert prepare.filter_customers(raw, {"Contract": []}).count() == 60
    kept = prepare.filter_customers(raw, {"Contract": ["One year", "Two year"], "InternetService": ["Fiber optic"]})
    expected = [
        r for r in customer_rows() if r["Contract"] != "Month-to-month" and r["InternetService"] == "Fiber optic"
    ]
    assert kept.count() == len(expected)
    assert prepare.filter_customers(raw, {"SeniorCitizen": [1]}).count() == 10
    with pytest.raises(KeyError, match="nowhere"):
        prepare.filter_customers(raw, {"nowhere": ["x"]})
    with pytest.raises(ValueError, match="matches no"):
        prepare.filter_customers(raw, {"Contract": ["a decade"]}, require_match=True)
    assert prepare.active_customers(raw).count() == 30
    with pytest.raises(KeyError, match=TARGET):
        prepare.active_customers(raw.drop(TARGET))


def test_quality_counts(make, raw):
    assert quality.data_quality(raw).first().asDict() == {
        "kunder": 60,
        "unika_id": 60,
        "dubbletter": 0,
        "tomma_totalcharges": 0,
    }
    rows = customer_rows()
    rows[0]["TotalCharges"] = " "
    rows[5]["gender"] = None
    near_copy = {**rows[7], "gender": "other"}
    found = quality.data_quality(make([*rows, rows[1], rows[5], rows[5], near_copy])).first()
    assert found.asDict() == {"kunder": 64, "unika_id": 60, "dubbletter": 3, "tomma_totalcharges": 1}
    with pytest.raises(KeyError, match="customerID"):
        quality.data_quality(raw.drop(ID))
    assert quality.unparseable_rows(make(rows)).count() == 1
    profile = {r["column"]: (r["dtype"], r["non_null"]) for r in quality.column_profile(make(rows)).collect()}
    assert profile["gender"] == ("string", 59) and profile["tenure"] == ("int", 60)
    levels = quality.distinct_values(make(rows), ["Contract", "gender"]).collect()
    assert [(r["column"], r["value"]) for r in levels] == [
        ("Contract", "Month-to-month"),
        ("Contract", "One year"),
        ("Contract", "Two year"),
        ("gender", "Female"),
        ("gender", "Male"),
    ]
