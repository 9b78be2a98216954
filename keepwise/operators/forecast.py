"""Recurring-revenue projections from per-customer churn probabilities."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise.functions import features as X
from keepwise.functions.features import check_range
from keepwise.functions.calendar import month_label
from keepwise.functions.numbers import guarded, number
from keepwise.operators.prepare import active_customers, enrich
from keepwise.operators.quality import require_columns
from keepwise.schema import GROUP_COLUMNS, LEFT, PROBABILITY, STAYED, TARGET

# Labels of the two chart series.
SERIES = {"total_mrr": "Månadsintäkt", "expected_mrr": "Dagens kunder utan nykunder"}


def _bad_inputs(charge: Column, p: Column) -> Column:
    """Rows that would make a projected sum wrong without anybody noticing."""
    return F.count_if(p.isNull() | charge.isNull() | F.isnan(p) | (p < 0) | (p > 1))


def revenue_forecast(
    df: DataFrame, months: int = 24, start: date | None = None, by: list[str] | None = None
) -> DataFrame:
    """Expected customers and revenue 0..months ahead, optionally per group.

    Every active customer stays for m months with probability (1-p)^m. One scan lists the
    months of each customer and sums them where they are read, so months+1 rows per task and
    group are shuffled. That generates small code; 2(months+1) sums side by side are twice as
    slow, being too large for the JIT compiler. Missing or impossible inputs, and having no
    active customers, fail the query.
    """
    keys = list(by or [])
    require_columns(df, PROBABILITY, "MonthlyCharges", TARGET, *keys)
    check_range("months", months, 1)
    first = (start or date.today()).replace(day=1)

    active = active_customers(df)
    for key in keys:
        active = active.filter(F.col(key).isNotNull())
    ahead = F.explode(F.array(*[F.lit(m) for m in range(months + 1)])).alias("_m")
    charge = number(df, "MonthlyCharges").cast("double").alias("_charge")
    listed = active.select(*keys, charge, F.col(PROBABILITY).cast("double").alias("_p"), ahead)
    stays = F.pow(1 - F.col("_p"), F.col("_m"))
    sums = listed.groupBy(*keys, "_m").agg(
        F.sum(stays).alias("customers"),
        F.sum(F.col("_charge") * stays).alias("mrr"),
        _bad_inputs(F.col("_charge"), F.col("_p")).alias("bad"),
    )
    # months+1 entries per group, in order.
    line = F.array_sort(F.collect_list(F.struct("_m", "customers", "mrr", "bad")))
    lines = sums.groupBy(*keys).agg(line.alias("_line"))
    none = F.raise_error(F.lit("there is nobody left to project revenue for"))
    wrong = F.raise_error(F.lit(f"{PROBABILITY} must lie in [0, 1] and charges be known"))
    checked = F.when(F.size("_line") == 0, none).when(F.col("_line")[0]["bad"] > 0, wrong)
    lines = lines.withColumn("_line", checked.otherwise(F.col("_line")))

    def month_row(entry: Column, m: Column) -> Column:
        before = F.coalesce(F.get("_line", m - 1)["mrr"], entry["mrr"])
        return F.struct(
            m.alias("months_ahead"),
            F.add_months(F.lit(first), m).alias("month"),
            entry["customers"].alias("expected_customers"),
            entry["mrr"].alias("expected_mrr"),
            (before - entry["mrr"]).alias("expected_loss"),
            (F.col("_line")[0]["mrr"] - entry["mrr"]).alias("cumulative_loss"),
        )

    return lines.select(*keys, F.inline(F.transform("_line", month_row))).select(
        *keys,
        "months_ahead",
        "month",
        month_label(F.col("month")).alias("month_label"),
        "expected_customers",
        "expected_mrr",
        "expected_loss",
        "cumulative_loss",
    )


def kpis(df: DataFrame) -> DataFrame:
    """One row of headline figures; all but actual_loss_last_month over active customers."""
    require_columns(df, PROBABILITY, "MonthlyCharges", TARGET)
    charge, p = number(df, "MonthlyCharges").cast("double"), F.col(PROBABILITY)
    stayed, left = F.col(TARGET) == STAYED, F.col(TARGET) == LEFT

    def total(value, rows):
        return F.coalesce(F.sum(F.when(rows, value)), F.lit(0.0))

    sums = df.agg(
        total(charge, stayed).alias("mrr_today"),
        total(charge * p, stayed).alias("expected_loss_next_month"),
        total(charge, left).alias("actual_loss_last_month"),
        F.avg(F.when(stayed, p)).alias("predicted_churn_rate"),
        F.count_if(stayed).alias("n_customers"),
        F.count_if(stayed & ((p < 0) | (p > 1))).alias("_bad"),
    )
    # One checked struct: whichever figure is read, the checks come with it.
    figures = F.struct(*[c for c in sums.columns if c != "_bad"])
    nobody = F.raise_error(F.lit("there is nobody left to project revenue for"))
    outside = F.raise_error(F.lit(f"{PROBABILITY} must lie in [0, 1]"))
    checked = F.when(F.col("n_customers") == 0, nobody).when(F.col("_bad") > 0, outside).otherwise(figures)
    return sums.select(checked.alias("_k")).select("_k.*")


def group_breakdown(df: DataFrame, column: str) -> DataFrame:
    """Active customers, revenue, mean risk and expected loss per group, largest loss first.

    Having no active customers at all is an error.
    """
    if column not in GROUP_COLUMNS:
        raise KeyError(f"{column!r} is no breakdown column; these are: {', '.join(GROUP_COLUMNS)}")
    require_columns(df, PROBABILITY)
    active = active_customers(enrich(df))
    if active.isEmpty():
        raise ValueError("there is nobody left to break down")
    data = active.filter(F.col(column).isNotNull())
    charge, p = F.col("MonthlyCharges"), F.col(PROBABILITY)
    return (
        data.groupBy(column)
        .agg(
            F.count("*").alias("antal_kunder"),
            F.coalesce(F.sum(charge), F.lit(0.0)).alias("mrr"),
            F.avg(p).alias("predikterad_churn"),
            F.coalesce(F.sum(charge * p), F.lit(0.0)).alias("forvantad_forlust_nasta_manad"),
        )
        .orderBy(F.desc("forvantad_forlust_nasta_manad"), column)
    )


def risk_cards(df: DataFrame, column: str) -> DataFrame:
    """The breakdown with a colour band on the mean risk."""
    return group_breakdown(df, column).withColumn("risk_band", X.risk_band(F.col("predikterad_churn")))


def with_new_customers(
    forecast: DataFrame,
    cohorts: DataFrame,
    monthly_risk: float | Column,
    by: list[str] | None = None,
) -> DataFrame:
    """Add supplied new-customer cohorts to a forecast.

    ``cohorts`` holds months_ahead, new_customers and monthly_charge (and the group keys).
    Each cohort row is spread over the months it lives in, at most months+1 rows, and summed
    per month; that replaces a join on k <= m. Cohorts of month 0 or past the horizon add
    nothing, as do cohorts without a count. A group that only the cohorts have starts without revenue.
    """
    keys = list(by or [])
    require_columns(forecast, "months_ahead", "expected_mrr", "expected_loss", *keys)
    require_columns(cohorts, "months_ahead", "new_customers", "monthly_charge", *keys)
    if not isinstance(monthly_risk, Column):
        check_range("monthly_risk", monthly_risk, 0, 1)
        monthly_risk = F.lit(float(monthly_risk))
    else:
        bad = monthly_risk.isNull() | (monthly_risk < 0) | (monthly_risk > 1)
        monthly_risk = guarded(monthly_risk, bad, "monthly_risk must lie in [0, 1]")

    horizon = forecast.agg(F.max("months_ahead")).scalar()
    born = F.col("months_ahead")
    living = cohorts.filter(born >= 1).groupBy(*keys, "months_ahead").agg(
        F.sum("new_customers").cast("double").alias("n"),
        F.sum(F.col("new_customers") * F.col("monthly_charge")).alias("income"),
    )
    spread = (
        living.withColumn("_end", horizon)
        .filter(born <= F.col("_end"))
        .select(*keys, born.alias("born"), "n", "income", F.explode(F.sequence(born, F.col("_end"))).alias("m"))
        .withColumn("_risk", monthly_risk)
        .groupBy(*keys, F.col("m").alias("months_ahead"))
        .agg(
            F.sum(F.when(F.col("born") == F.col("m"), F.col("n"))).alias("new_customers"),
            F.sum(F.col("income") * F.pow(1 - F.col("_risk"), F.col("m") - F.col("born"))).alias("new_mrr"),
        )
    )
    joined = forecast.join(spread, [*keys, "months_ahead"], "left")
    if keys:
        joined = _with_new_groups(forecast, spread, keys)
    previous = F.lag("new_mrr", 1, 0.0).over(Window.partitionBy(*keys).orderBy("months_ahead"))
    return (
        joined.withColumns(
            {
                "new_customers": F.coalesce(F.col("new_customers"), F.lit(0.0)).cast("bigint"),
                "new_mrr": F.coalesce(F.col("new_mrr"), F.lit(0.0)),
            }
        )
        .withColumn("total_mrr", F.col("expected_mrr") + F.col("new_mrr"))
        .withColumn("total_loss", F.col("expected_loss") + previous * monthly_risk)
    )


def _with_new_groups(forecast: DataFrame, spread: DataFrame, keys: list[str]) -> DataFrame:
    """Forecast and cohorts by group and month, groups of only one side included (null keys too)."""
    calendar = [c for c in ("month", "month_label") if c in forecast.columns]
    months = forecast.select("months_ahead", *calendar).distinct()
    groups = forecast.select(*keys).unionByName(spread.select(*keys)).distinct()
    # Groups times the months of the horizon: as many rows as the result has.
    listed = months.agg(F.collect_list(F.struct("months_ahead", *calendar)).alias("_months"))
    frame = groups.withColumn("_months", listed.scalar()).select(*keys, F.inline("_months"))

    def same(other: str) -> Column:
        on = F.col("f.months_ahead") == F.col(f"{other}.months_ahead")
        for k in keys:
            on = on & F.col(f"f.{k}").eqNullSafe(F.col(f"{other}.{k}"))
        return on

    known = [c for c in forecast.columns if c not in (*keys, "months_ahead", *calendar)]
    joined = frame.alias("f").join(forecast.alias("o"), same("o"), "left").join(spread.alias("s"), same("s"), "left")
    given = {c: F.coalesce(F.col(f"o.{c}"), F.lit(0.0)).alias(c) for c in known}
    columns = [given[c] if c in given else F.col(f"f.{c}") for c in forecast.columns]
    return joined.select(*columns, "s.new_customers", "s.new_mrr")


def with_losses(table: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Loss against the previous month and since the first one, for any months_ahead table."""
    w = Window.partitionBy(*(by or [])).orderBy("months_ahead")
    since = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return table.withColumns(
        {
            "loss": F.coalesce(F.lag(value).over(w) - F.col(value), F.lit(0.0)),
            "cumulative": since - F.col(value),
        }
    )


def forecast_series(forecast: DataFrame) -> DataFrame:
    """Chart rows (serie, belopp): one per month and series."""
    named = forecast.withColumnsRenamed(SERIES)
    return named.unpivot(["months_ahead", "month_label"], list(SERIES.values()), "serie", "belopp")


def horizon_value(forecast: DataFrame, value: str = "total_mrr") -> DataFrame:
    """The value in the last forecast month."""
    return forecast.agg(F.max_by(value, "months_ahead").alias(value))
