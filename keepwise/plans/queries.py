"""Named queries over the given tables. Doubles are rounded for comparison with other engines."""

from __future__ import annotations

from datetime import date
from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwise.functions import features as X
from keepwise.operators import (
    eda,
    forecast,
    metrics,
    models,
    prepare,
    pricing,
    quality,
    segments,
    split,
    trees,
)
from keepwise.operators.stages import BalancedWeights, NumericScaler
from keepwise.operators.trees import HistogramTrees
from keepwise.plans import dashboard as dashboards
from keepwise.plans.tables import (
    customers,
    customers_path,
    fresh_path,
    once,
    outcomes,
    scored,
    trained,
    with_group_rate,
)
from keepwise.schema import (
    EDA_CATEGORIES,
    FEATURES,
    GROUP_COLUMNS,
    ID,
    LABEL,
    NUMERIC,
    PRICE_FEATURES,
    PROBABILITY,
    REQUIRED,
    SIMPLE_FEATURES,
    TARGET,
)
from keepwise.session import write_table
from keepwise.sources import customers as customer_source
from keepwise.sources import logs
from keepwise.sources.subscribers import subscribers
from keepwise.streaming.scoring import score_stream

START = date(2026, 9, 16)
HORIZON = 12
THRESHOLD = 0.25
THRESHOLD_LIST = [0.2, 0.22, 0.24, 0.26, 0.28, 0.5]
FILTERS = {"Contract": ["One year", "Two year"], "InternetService": ["Fiber optic"], "PaymentMethod": []}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to fixed digits, with negative zero as zero."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in doubles})


def _on(table, operator, *args, digits=6, **kwargs):
    """A query that applies an operator to one of the stored tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(operator(table(spark, sf_dir), *args, **kwargs), digits)

    return query


# --- sources and sinks


def subscriber_rows(spark, sf_dir):
    return rounded(subscribers(spark, sf_dir))


def csv_ingest(spark, sf_dir):
    """Customers exported to CSV, then validated and ingested into a table from there."""
    text = customer_source.export_csv(customers(spark, sf_dir), fresh_path(spark, "customers_csv"))
    return rounded(customer_source.load_or_ingest(spark, text, fresh_path(spark, "ingested")))


def scored_export(spark, sf_dir):
    """Scored customers with all their columns, written as CSV and read back."""
    table = scored(spark, sf_dir)
    rows = table.select(*REQUIRED, PROBABILITY, X.decision(F.col(PROBABILITY), THRESHOLD).alias("predicted_churn"))
    back = customer_source.read_csv(spark, customer_source.export_csv(rows, fresh_path(spark, "export")))
    return rounded(back.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]))


def prediction_log_latest(spark, sf_dir):
    """The latest 50 of two appended batches of logged predictions."""
    log = fresh_path(spark, "predictions")
    table = scored(spark, sf_dir)
    logs.log_predictions(table, log, 0.5, "2026-01-01T00:00:00")
    logs.log_predictions(table, log, THRESHOLD, "2026-01-02T00:00:00")
    return rounded(logs.load_predictions(spark, log, 50))


def _runs(spark, sf_dir):
    summary = trained(spark, sf_dir).summary
    runs = [
        {"model_name": m["model"], "stage": "validation", "best_params": m["best_params"], "metrics": m["validation"]}
        for m in summary["models"]
    ]
    best = next(m for m in summary["models"] if m["model"] == summary["best_model"])
    return [*runs, {"model_name": best["model"], "stage": "test", "best_params": best["best_params"], "metrics": summary["test"]}]


def model_runs_latest(spark, sf_dir):
    log = fresh_path(spark, "model_runs")
    logs.log_model_runs(spark, log, _runs(spark, sf_dir), "2026-01-01T00:00:00")
    return logs.load_model_runs(spark, log)


# --- quality


def distinct_values(spark, sf_dir):
    table = customers(spark, sf_dir)
    return quality.distinct_values(table, quality.categorical_columns(table))


# --- features and exploration


def clean_features(spark, sf_dir):
    return rounded(prepare.features_with_label(customers(spark, sf_dir)).select(ID, *FEATURES, LABEL))


# --- revenue


def _cohorts(spark, sf_dir, keys=()):
    """New customers per month ahead: as many, at the same mean charge, as now have that tenure."""
    table = scored(spark, sf_dir).filter(F.col("tenure").between(1, HORIZON))
    return table.groupBy(*keys, F.col("tenure").alias("months_ahead")).agg(
        F.count("*").alias("new_customers"), F.avg("MonthlyCharges").alias("monthly_charge")
    )


def _risk(spark, sf_dir):
    return forecast.kpis(scored(spark, sf_dir)).select("predicted_churn_rate").scalar()


def _rollforward(spark, sf_dir, keys=None):
    base = forecast.revenue_forecast(scored(spark, sf_dir), HORIZON, START, keys)
    return forecast.with_new_customers(base, _cohorts(spark, sf_dir, keys or ()), _risk(spark, sf_dir), keys)


def cohort_rollforward(spark, sf_dir):
    return rounded(_rollforward(spark, sf_dir))


def cohort_rollforward_by_contract(spark, sf_dir):
    return rounded(_rollforward(spark, sf_dir, ["Contract"]))


def forecast_long(spark, sf_dir):
    return rounded(forecast.forecast_series(_rollforward(spark, sf_dir)))


def forecast_horizon(spark, sf_dir):
    return rounded(forecast.horizon_value(_rollforward(spark, sf_dir)))


def forecast_losses(spark, sf_dir):
    table = forecast.revenue_forecast(scored(spark, sf_dir), HORIZON, START, ["InternetService"])
    kept = table.select("InternetService", "months_ahead", "expected_mrr")
    return rounded(forecast.with_losses(kept, "expected_mrr", ["InternetService"]))


def dashboard_forecast(spark, sf_dir):
    board = dashboards.dashboard(
        scored(spark, sf_dir), _cohorts(spark, sf_dir), FILTERS, HORIZON, "PaymentMethod", START
    )
    return rounded(board.forecast)


# --- evaluation


def flagged_count(spark, sf_dir):
    flag = X.decision(F.col(PROBABILITY), THRESHOLD)
    return models.flagged_count(scored(spark, sf_dir).withColumn("predicted_churn", flag))


def top_risk_customers(spark, sf_dir):
    return rounded(models.rank_by_risk(scored(spark, sf_dir).select(ID, "Contract", PROBABILITY)))


# --- splits and preprocessing


def stratified_split(spark, sf_dir):
    return split.split_data(prepare.features_with_label(customers(spark, sf_dir)).select(ID, LABEL))


def cv_folds(spark, sf_dir):
    train = stratified_split(spark, sf_dir).filter(F.col("part") == "train")
    return split.with_folds(train).select(ID, LABEL, "fold")


def class_weights(spark, sf_dir):
    return rounded(split.class_weights(prepare.features_with_label(customers(spark, sf_dir))))


def balanced_weights(spark, sf_dir):
    """(label, weight) as the stage of the models gives them to rows."""
    rows = prepare.features_with_label(customers(spark, sf_dir)).select(LABEL)
    return rounded(BalancedWeights().fit(rows).transform(rows).distinct())


def imputed_scaled_numeric(spark, sf_dir):
    features = prepare.prepare_features(customers(spark, sf_dir))
    scaled = [f"{c}_scaled" for c in NUMERIC]
    model = NumericScaler(inputCols=NUMERIC, outputCols=scaled).fit(features)
    return rounded(model.transform(features).select(ID, *scaled))


def onehot_long(spark, sf_dir):
    """(customerID, feature, value): the non-zero one-hot entries of the assembled vector."""
    features = prepare.prepare_features(customers(spark, sf_dir))
    model = Pipeline(stages=models.preprocessing()).fit(features)
    names = F.array(*[F.lit(n) for n in models.feature_names(model)])
    entries = F.arrays_zip(names.alias("feature"), vector_to_array("features").alias("value"))
    long = model.transform(features).select(ID, F.posexplode(entries).alias("position", "e"))
    hot = (F.col("position") >= len(NUMERIC)) & (F.col("e.value") != 0)
    return long.filter(hot).select(ID, F.col("e.feature").alias("feature"), F.col("e.value").alias("value"))


# --- models


def model_scores(spark, sf_dir):
    model = trained(spark, sf_dir).model
    scores = models.score_batch(model, customers(spark, sf_dir).drop(TARGET), 0.5)
    return scores.select(ID, PROBABILITY, "predicted_churn")


def _training_vectors(spark, sf_dir):
    """The prepared training rows, their fitted stages, and how many rows there are."""
    rows = split.split_data(prepare.features_with_label(customers(spark, sf_dir))).filter("part = 'train'").drop("part")
    prepared = Pipeline(stages=models.training_stages()).fit(rows)
    n = rows.count()
    return prepared.transform(models.laid_out(rows, n)), prepared, n


def tree_levels(spark, sf_dir):
    """(node, feature, rows, n0, n1, gain) of a tree of three levels over the one-hot features."""
    vectors, prepared, _ = _training_vectors(spark, sf_dir)
    names = models.feature_names(prepared)
    hot = VectorSlicer(inputCol=models.FEATURES_COL, outputCol="hot", indices=list(range(len(NUMERIC), len(names))))
    estimator = HistogramTrees(maxDepth=3, minSplit=20, idCol=ID, featuresCol="hot", labelCol=LABEL, weightCol=models.WEIGHT)
    nodes = estimator.fit(hot.transform(vectors)).node_table(spark)
    feature = F.get(F.array(*[F.lit(n) for n in names[len(NUMERIC) :]]), F.nullif("feature", F.lit(-1)))
    return rounded(nodes.select("node", feature.alias("feature"), "rows", "n0", "n1", "gain"))


def forest_certificate(spark, sf_dir):
    """(what, n): a forest's votes walked over its node table, its counts, and its fit from other partitions."""
    vectors, prepared, _ = _training_vectors(spark, sf_dir)
    estimator = HistogramTrees(trees=12, maxDepth=4, maxFeatures="sqrt", minSplit=20, bagging=True, seed=1, idCol=ID, labelCol=LABEL, weightCol=models.WEIGHT)
    model = estimator.fit(vectors.repartition(4))
    nodes, other = (m.node_table(spark) for m in (model, estimator._set(groups=5).fit(vectors.repartition(31))))
    scored_rows = models.predict_proba(PipelineModel([*prepared.stages, model]), customers(spark, sf_dir))
    x = prepared.transform(prepare.prepare_features(customers(spark, sf_dir))).select(F.col(ID).alias("id"), vector_to_array("features").alias("x"))
    walked = trees.walked_scores(x, nodes, 4, tuple(model.getOrDefault(model.classWeights)))
    both = scored_rows.select(F.col(ID).alias("id"), PROBABILITY).join(walked, "id", "full")
    unlike = F.coalesce(F.abs(F.col(PROBABILITY) - F.col("score")) > 1e-9, F.lit(True))
    leaf = F.col("feature") < 0
    sums = nodes.groupBy("tree").agg(*[F.sum(F.when(leaf, F.col(c)).when(F.col("node") == 1, -F.col(c))).alias(c) for c in ("rows", "n0", "n1")])
    columns = [F.col(c) for c in nodes.columns]
    apart = nodes.exceptAll(other).unionByName(other.exceptAll(nodes)).select(columns)
    counts = [
        both.agg(F.lit("customers scored").alias("what"), F.count("*").alias("n")),
        both.agg(F.lit("scores unlike the votes of the node table"), F.count_if(unlike)),
        sums.agg(F.lit("trees whose leaves hold other rows than their root"), F.count_if(F.expr("rows <> 0 or n0 <> 0 or n1 <> 0"))),
        apart.agg(F.lit("nodes that depend on the partitions of the rows"), F.count("*")),
    ]
    return reduce(DataFrame.union, counts)


def logistic_gradient(spark, sf_dir):
    """(feature, gradient): slope of the penalised loss at the fitted weights; nothing at the optimum."""
    vectors, prepared, n = _training_vectors(spark, sf_dir)
    estimator = models.candidates()[0].build({"C": 1}, n)
    model = estimator.fit(vectors)
    names = ["intercept", *models.feature_names(prepared)]
    weights = [0.0, *[float(b) for b in model.coefficients]]
    p = vector_to_array(F.col("probability"))[1]
    residual = F.col(models.WEIGHT) * (p - F.col(LABEL))
    x = F.concat(F.array(F.lit(1.0)), vector_to_array(models.FEATURES_COL))
    slopes = model.transform(vectors).select(models.WEIGHT, residual.alias("r"), F.posexplode(x).alias("position", "x"))
    sums = slopes.groupBy("position").agg((F.sum(F.col("r") * F.col("x")) / F.sum(models.WEIGHT)).alias("slope"))
    at = F.get(F.array(*[F.lit(b) for b in weights]), F.col("position"))
    name = F.get(F.array(*[F.lit(c) for c in names]), F.col("position"))
    return rounded(sums.select(name.alias("feature"), (F.col("slope") + at * estimator.getRegParam()).alias("gradient")), 4)


def held_out_predictions(spark, sf_dir):
    path = fresh_path(spark, "test_predictions")
    logs.write_test_predictions(trained(spark, sf_dir).test_predictions, path)
    return logs.read_test_predictions(spark, path)


def held_out_rows(spark, sf_dir):
    return held_out_predictions(spark, sf_dir).select(ID, "y_true")


def model_comparison(spark, sf_dir):
    path = fresh_path(spark, "results")
    logs.write_results(spark, path, trained(spark, sf_dir).summary)
    compared = logs.model_comparison(logs.read_results(spark, path))
    return compared.withColumn("best_params", F.to_json("best_params"))


def feature_importance(spark, sf_dir):
    return models.feature_importance(spark, trained(spark, sf_dir).model)


def top_features(spark, sf_dir):
    return models.top_features(feature_importance(spark, sf_dir))


# --- segments


def kmeans_scores(spark, sf_dir):
    return segments.kmeans_scores(segments.cluster_vectors(customers(spark, sf_dir)))


def kmeans_certificate(spark, sf_dir):
    """(what, n): every customer has the nearest centre, centres are means, the costs add up."""
    vectors = segments.cluster_vectors(customers(spark, sf_dir))
    found = segments.best_kmeans(vectors, [4], starts=3)[4]
    x = found.label(vectors, "segment").select("segment", vector_to_array("features").alias("x"))
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in found.centres])
    away = F.transform(centres, lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    measured = x.select("segment", "x", away.alias("away"))
    own = F.get("away", F.col("segment"))
    rows = measured.agg(F.count("*").alias("n"), F.count_if(own > F.array_min("away") + 1e-9).alias("far"), F.sum(own).alias("cost"))
    means = x.select("segment", F.posexplode("x").alias("at", "v")).groupBy("segment", "at").agg(F.avg("v").alias("mean"))
    centre = F.get(F.get(centres, F.col("segment")), F.col("at"))
    off = means.agg(F.count_if(F.abs(F.col("mean") - centre) > 0.05).alias("off"))
    cost_off = (F.abs(F.col("cost") - F.lit(found.cost)) > 1e-6 * found.cost).cast("long")
    counts = [
        rows.select(F.lit("customers labelled").alias("what"), F.col("n")),
        rows.select(F.lit("customers nearer to another centre"), F.col("far")),
        rows.select(F.lit("inertia unlike the sum of squared distances"), cost_off),
        off.select(F.lit("centre coordinates off the mean of their rows"), F.col("off")),
    ]
    return reduce(DataFrame.union, counts)


def _fitted_segments(spark, sf_dir, columns=None):
    """The rows with their segments, and the explained variance; fitted once per application."""

    def build():
        vectors = segments.cluster_vectors(customers(spark, sf_dir), columns)
        labelled, explained = segments.fit_segments(vectors)
        return write_table(labelled, fresh_path(spark, "segments")), explained

    return once(spark, sf_dir, f"segments {columns}", build)


def pca_projection(spark, sf_dir):
    return _fitted_segments(spark, sf_dir)[0].select(ID, "segment", "pc1", "pc2")


def pca_explained_variance(spark, sf_dir):
    shares = list(enumerate(_fitted_segments(spark, sf_dir)[1], 1))
    return spark.createDataFrame(shares, "component int, share double")


def segment_profiles(spark, sf_dir):
    return segments.segment_profiles(_fitted_segments(spark, sf_dir)[0])


def simple_segment_profiles(spark, sf_dir):
    return segments.segment_profiles(_fitted_segments(spark, sf_dir, SIMPLE_FEATURES)[0])


def fixed_silhouette(spark, sf_dir):
    """Silhouette of segments by tenure, on two plain features."""
    points = VectorAssembler(inputCols=["tenure", "MonthlyCharges"], outputCol="features")
    labelled = points.transform(_fixed_segments(spark, sf_dir).select("segment", "tenure", "MonthlyCharges"))
    return rounded(spark.createDataFrame([(segments.silhouette(labelled),)], "silhouette double"))


def dashboard_by_segment(spark, sf_dir):
    """Headline figures of the customers of two fixed segments."""
    table = scored(spark, sf_dir).withColumn("segment", (F.col("tenure") % 4).cast("int"))
    filters = {"segment": [1, 2], "Contract": ["Two year", "One year"]}
    return rounded(dashboards.dashboard(table, _cohorts(spark, sf_dir), filters, HORIZON, "Contract", START).kpis)


def _fixed_segments(spark, sf_dir):
    return customers(spark, sf_dir).withColumn("segment", (F.col("tenure") % 4).cast("int"))


def segment_profiles_fixed(spark, sf_dir):
    return rounded(segments.segment_profiles(_fixed_segments(spark, sf_dir), rounded=False))


def extreme_segments(spark, sf_dir):
    profiles = segments.segment_profiles(_fixed_segments(spark, sf_dir), rounded=False)
    return rounded(segments.extreme_segments(profiles))


# --- pricing


def pricing_split(spark, sf_dir):
    return pricing.split_pricing(pricing.pricing_data(customers(spark, sf_dir))).select(ID, "part")


def price_bundles(spark, sf_dir):
    return rounded(pricing.bundles(pricing.pricing_data(customers(spark, sf_dir))))


def price_gramian(spark, sf_dir):
    return pricing.gramian(pricing.bundles(pricing.pricing_data(customers(spark, sf_dir))))


def price_moments(spark, sf_dir):
    return rounded(pricing.moments(pricing.bundles(pricing.pricing_data(customers(spark, sf_dir)))))


def _price_model(spark, sf_dir):
    def build():
        return pricing.train_price_model(pricing.pricing_data(customers(spark, sf_dir)))

    return once(spark, sf_dir, "price model", build)


def price_list(spark, sf_dir):
    return rounded(pricing.price_list(spark, _price_model(spark, sf_dir)[0]))


def price_residuals(spark, sf_dir):
    """(feature, level, residual): what least squares leaves on average at each level of all features of the training rows: nothing."""
    data = pricing.split_pricing(pricing.pricing_data(customers(spark, sf_dir))).filter("part = 'train'")
    left = data.withColumn("residual", F.col("MonthlyCharges") - _price_model(spark, sf_dir)[0].price())
    levels = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in PRICE_FEATURES]
    long = left.select("residual", F.inline(F.array(*levels)))
    return rounded(long.groupBy("feature", "level").agg(F.avg("residual").alias("residual")), 4)


def price_r2(spark, sf_dir):
    return rounded(_price_model(spark, sf_dir)[1])


def price_quotes(spark, sf_dir):
    table = customers(spark, sf_dir)
    observed = pricing.pricing_data(table)
    model, _ = _price_model(spark, sf_dir)
    quotes = pricing.price_quotes(table, model, observed)
    return rounded(quotes.select(ID, "manadspris", "extrapolated"))


def unseen_bundles(spark, sf_dir):
    """Every customer's bundle as a quote: is its internet and phone pair one we have priced?"""
    table = customers(spark, sf_dir)
    flagged = pricing.flag_unseen(table, pricing.pricing_data(table))
    return flagged.select(ID, "InternetService", "PhoneService", "extrapolated")


# --- streaming


def stream_scoring(spark, sf_dir):
    table = customers(spark, sf_dir)
    sink = fresh_path(spark, "stream_predictions")
    query = score_stream(
        spark,
        customers_path(spark, sf_dir),
        table.schema,
        lambda rows: with_group_rate(rows, table),
        sink,
        fresh_path(spark, "stream_checkpoint"),
        THRESHOLD,
        "2026-01-01T00:00:00",
    )
    query.awaitTermination()
    return rounded(spark.read.parquet(sink))


def stream_model_scoring(spark, sf_dir):
    """The stream scored with the trained model; equal to the batch scores."""
    model, sink = trained(spark, sf_dir).model, fresh_path(spark, "stream_model_predictions")
    query = score_stream(
        spark,
        customers_path(spark, sf_dir),
        customers(spark, sf_dir).schema,
        partial(models.predict_proba, model),
        sink,
        fresh_path(spark, "stream_checkpoint"),
        0.5,
        "2026-01-01T00:00:00",
    )
    query.awaitTermination()
    return spark.read.parquet(sink).select(ID, PROBABILITY, "predicted_churn")


def score_and_export(spark, sf_dir):
    """CSV in, model scores, decision, rank, all columns out to CSV, read back."""
    path = customer_source.export_csv(customers(spark, sf_dir).drop(TARGET), fresh_path(spark, "to_score"))
    rows = customer_source.read_csv(spark, path)
    ranked = models.rank_by_risk(models.score_batch(trained(spark, sf_dir).model, rows, 0.5))
    out = customer_source.export_csv(ranked, fresh_path(spark, "scored_csv"))
    back = customer_source.read_csv(spark, out)
    return back.withColumns({PROBABILITY: F.col(PROBABILITY).cast("double"), "predicted_churn": F.col("predicted_churn").cast("int")})


def unique_outcomes(spark, sf_dir):
    """Outcomes with a probability of its own for nearly every customer, from a hash of the id."""
    digits = F.substring(F.md5(ID), 1, 7)
    p = F.conv(digits, 16, 10).cast("double") / float(1 << 28)
    return outcomes(spark, sf_dir).select(ID, "y_true", p.alias(PROBABILITY))


def flagship(spark, sf_dir):
    """Which contract type has the most revenue at risk next month?"""
    return rounded(forecast.group_breakdown(scored(spark, sf_dir), "Contract"))


QUERIES = {
    "subscribers": subscriber_rows,
    "csv_ingest": csv_ingest,
    "scored_export": scored_export,
    "customers_preview": _on(customers, customer_source.preview),
    "prediction_log_latest": prediction_log_latest,
    "model_runs_latest": model_runs_latest,
    "data_quality": _on(customers, quality.data_quality),
    "column_profile": _on(customers, quality.column_profile),
    "distinct_values": distinct_values,
    "unparseable_rows": _on(customers, quality.unparseable_rows),
    "clean_features": clean_features,
    "filter_customers": _on(customers, prepare.filter_customers, FILTERS),
    "active_customers": _on(customers, prepare.active_customers),
    **{f"churn_rate_by_{c}": _on(customers, eda.churn_rate_by, c) for c in EDA_CATEGORIES},
    "churn_rate_with_mean": _on(customers, eda.churn_rate_with_mean, "Contract"),
    "churn_by_price_band": _on(customers, eda.churn_rate_by_price_band),
    "churn_correlations": _on(customers, eda.churn_correlations),
    "correlation_matrix": _on(customers, eda.correlation_matrix),
    "target_share": _on(customers, eda.target_share),
    "describe_numeric": _on(
        customers, eda.describe, ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"], digits=3
    ),
    "describe_by_churn": _on(
        customers, eda.describe_by_churn, ["tenure", "MonthlyCharges", "TotalCharges"], digits=3
    ),
    "tenure_histogram": _on(customers, eda.tenure_histogram),
    "class_histogram_tenure": _on(customers, eda.class_histogram, "tenure"),
    "class_histogram_charges": _on(customers, eda.class_histogram, "MonthlyCharges"),
    "headline_means": _on(customers, eda.headline_means),
    "median_inputs": _on(customers, eda.medians, ["MonthlyCharges", "TotalCharges"]),
    "charge_deviation": _on(customers, eda.charge_deviation, digits=3),
    "kpis": _on(scored, forecast.kpis),
    "revenue_forecast": _on(scored, forecast.revenue_forecast, 24, START),
    "revenue_forecast_by_contract": _on(scored, forecast.revenue_forecast, HORIZON, START, ["Contract"]),
    **{f"group_breakdown_{c}": _on(scored, forecast.group_breakdown, c) for c in GROUP_COLUMNS},
    "risk_cards": _on(scored, forecast.risk_cards, "InternetService"),
    "cohort_rollforward": cohort_rollforward,
    "cohort_rollforward_by_contract": cohort_rollforward_by_contract,
    "forecast_long": forecast_long,
    "forecast_horizon": forecast_horizon,
    "forecast_losses": forecast_losses,
    "dashboard_forecast": dashboard_forecast,
    "scored_customers": _on(outcomes, lambda df: df),
    "top_risk_customers": top_risk_customers,
    "flagged_count": flagged_count,
    "confusion_matrix": _on(outcomes, metrics.confusion_matrix, THRESHOLD),
    "metrics_at_threshold": _on(outcomes, metrics.compute_metrics, THRESHOLD),
    "threshold_table": _on(outcomes, metrics.threshold_table, THRESHOLD_LIST),
    "roc_auc": _on(outcomes, metrics.roc_auc),
    "roc_points": _on(outcomes, partial(metrics.roc_points, drop_collinear=False)),
    "roc_curve": _on(outcomes, metrics.roc_points),
    "classification_report": _on(outcomes, metrics.classification_report, THRESHOLD),
    "balanced_weights": balanced_weights,
    "stratified_split": stratified_split,
    "cv_folds": cv_folds,
    "class_weights": class_weights,
    "imputed_scaled_numeric": imputed_scaled_numeric,
    "onehot_long": onehot_long,
    "model_scores": model_scores,
    "tree_levels": tree_levels,
    "forest_certificate": forest_certificate,
    "logistic_gradient": logistic_gradient,
    "held_out_predictions": held_out_predictions,
    "held_out_rows": held_out_rows,
    "model_comparison": model_comparison,
    "feature_importance": feature_importance,
    "top_features": top_features,
    "kmeans_scores": kmeans_scores,
    "kmeans_certificate": kmeans_certificate,
    "pca_projection": pca_projection,
    "pca_explained_variance": pca_explained_variance,
    "segment_profiles": segment_profiles,
    "simple_segment_profiles": simple_segment_profiles,
    "fixed_silhouette": fixed_silhouette,
    "dashboard_by_segment": dashboard_by_segment,
    "segment_profiles_fixed": segment_profiles_fixed,
    "extreme_segments": extreme_segments,
    "pricing_split": pricing_split,
    "price_bundles": price_bundles,
    "price_gramian": price_gramian,
    "price_moments": price_moments,
    "price_list": price_list,
    "price_residuals": price_residuals,
    "price_r2": price_r2,
    "price_quotes": price_quotes,
    "unseen_bundles": unseen_bundles,
    "stream_scoring": stream_scoring,
    "stream_model_scoring": stream_model_scoring,
    "score_and_export": score_and_export,
    "unique_metrics": _on(unique_outcomes, metrics.compute_metrics, 0.5),
    "unique_roc_auc": _on(unique_outcomes, metrics.roc_auc),
    "unique_roc_points": _on(unique_outcomes, partial(metrics.roc_points, drop_collinear=False)),
}
