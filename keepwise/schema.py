"""Column names, types and fixed values of the customer table."""

from __future__ import annotations

from pyspark.sql import types as T

ID = "customerID"
TARGET = "Churn"
PROBABILITY = "churn_probability"
LABEL = "label"

# The customer table's columns.
RAW_NUMERIC = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
RAW_CATEGORICAL = [
    "gender",
    "Partner",
    "Dependents",
    "PhoneService",
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
]
ADDON_SERVICES = [
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
]
RAW_FEATURES = RAW_NUMERIC + RAW_CATEGORICAL
REQUIRED = [ID, *RAW_FEATURES, TARGET]
NUMERIC = [*RAW_NUMERIC, "num_addon_services", "avg_monthly_charge"]
CATEGORICAL = [*RAW_CATEGORICAL, "tenure_group"]
FEATURES = NUMERIC + CATEGORICAL

# Target levels.
STAYED, LEFT = "No", "Yes"

# Right-closed bins, (lower, upper] -> label.
TENURE_BINS = [(-1, 12, "0-12"), (12, 24, "13-24"), (24, 48, "25-48"), (48, None, "49+")]
PRICE_BINS = [
    (0, 30, "18-30"),
    (30, 50, "30-50"),
    (50, 70, "50-70"),
    (70, 90, "70-90"),
    (90, 110, "90-110"),
    (110, 130, "110-130"),
]

# Columns offered for churn shares, revenue grouping, clustering and pricing.
EDA_CATEGORIES = [
    "Contract",
    "tenure_group",
    "InternetService",
    "PaymentMethod",
    "TechSupport",
    "OnlineSecurity",
    "PaperlessBilling",
    "SeniorCitizen",
    "Partner",
    "Dependents",
]
GROUP_COLUMNS = ["Contract", "InternetService", "PaymentMethod", "tenure_group"]
SIMPLE_FEATURES = ["tenure", "MonthlyCharges", "num_addon_services"]
PRICE_FEATURES = [
    "PhoneService",
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
]

# Swedish month abbreviations used in forecast labels.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "Maj", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dec"]

# Text that the CSV reader of pandas treats as missing.
MISSING_TEXT = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# The stored customer table. TotalCharges stays text so that blank values remain visible.
CUSTOMER_TYPES = {
    ID: T.StringType(),
    **{c: T.StringType() for c in RAW_CATEGORICAL},
    "SeniorCitizen": T.IntegerType(),
    "tenure": T.IntegerType(),
    "MonthlyCharges": T.DoubleType(),
    "TotalCharges": T.StringType(),
    TARGET: T.StringType(),
}


class SchemaError(ValueError):
    """The data does not have the shape the engine works on."""
