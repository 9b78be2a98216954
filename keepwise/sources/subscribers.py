"""Customer table derived from the order tables (customer, nation, orders, lineitem, part)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.schema import ADDON_SERVICES, REQUIRED

# Part type that stands for each add-on service.
ADDON_PART_TYPES = dict(
    zip(ADDON_SERVICES, ["STANDARD", "PROMO", "ECONOMY", "MEDIUM", "SMALL", "LARGE"], strict=True)
)


def _yes(condition: Column) -> Column:
    return F.when(condition, "Yes").otherwise("No")


def _month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer that has orders.

    Line items shrink to one bit mask per order before they meet the orders, and all order
    columns are then folded in a single aggregation per customer.
    """

    def table(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    bit = F.lit(None).cast("int")
    for position, part_type in enumerate(ADDON_PART_TYPES.values()):
        bit = F.when(F.col("p_type") == part_type, 1 << position).otherwise(bit)
    parts = (
        table("part")
        .filter(F.col("p_type").isin(list(ADDON_PART_TYPES.values())))
        .select("p_partkey", bit.alias("bit"))
    )
    addons = (
        table("lineitem")
        .filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
        .select("l_orderkey", "l_partkey")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_orderkey")
        .agg(F.bit_or("bit").alias("mask"))
    )

    orders = table("orders")
    newest = F.struct("o_orderdate", "o_orderkey")
    urgent, high, low = (F.col("o_orderpriority") == p for p in ("1-URGENT", "2-HIGH", "5-LOW"))
    per_customer = (
        orders.join(addons, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .groupBy("o_custkey")
        .agg(
            F.max_by(F.struct("o_orderdate", "o_totalprice", "o_orderstatus"), newest).alias("last"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"),
            F.coalesce(F.bit_or("mask"), F.lit(0)).alias("mask"),
            F.bool_or(urgent).alias("urgent"),
            F.bool_or(high).alias("high"),
            F.bool_or(low).alias("low"),
        )
    )
    last_month = orders.agg(F.max(_month_index(F.col("o_orderdate")))).scalar()

    joined = (
        table("customer")
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"))
    )
    tenure = (F.col("c_custkey") % 73).cast("int")
    offline = F.col("n_regionkey") == 0
    status = F.col("last.o_orderstatus")
    columns = {
        "customerID": F.col("c_custkey").cast("string"),
        "gender": F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male"),
        "SeniorCitizen": (F.col("c_acctbal") < 0).cast("int"),
        "Partner": _yes(F.col("c_nationkey") % 2 == 0),
        "Dependents": _yes(F.col("c_nationkey") % 3 == 0),
        "tenure": tenure,
        "PhoneService": _yes(F.col("urgent")),
        "MultipleLines": F.when(~F.col("urgent"), "No phone service").otherwise(_yes(F.col("high"))),
        "InternetService": F.when(offline, "No")
        .when(F.col("n_regionkey") <= 2, "DSL")
        .otherwise("Fiber optic"),
        "Contract": F.when(status == "O", "Month-to-month")
        .when(status == "P", "One year")
        .when(status == "F", "Two year"),
        "PaperlessBilling": _yes(F.col("low")),
        "PaymentMethod": F.col("c_mktsegment"),
        "MonthlyCharges": F.col("last.o_totalprice") / 4200,
        "TotalCharges": F.when(tenure == 0, " ").otherwise(F.col("total").cast("string")),
        "Churn": _yes(last_month - _month_index(F.col("last.o_orderdate")) >= 12),
    }
    for position, service in enumerate(ADDON_SERVICES):
        has = F.col("mask").bitwiseAND(F.lit(1 << position)) != 0
        columns[service] = F.when(offline, "No internet service").otherwise(_yes(has))
    return joined.select([columns[name].alias(name) for name in REQUIRED])
