"""Preprocessing, the candidate classifiers, cross-validated search, importance and scoring."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import (
    OneHotEncoder,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.functions.features import decision
from keepwise.operators.metrics import roc_auc_by
from keepwise.operators.prepare import enrich
from keepwise.operators.quality import check_columns
from keepwise.operators.split import FOLDS, SEED, with_folds
from keepwise.operators.stages import BalancedWeights, ModeImputer, NumericScaler
from keepwise.operators.trees import Binned, HistogramTrees, NodeTableModel
from keepwise.schema import CATEGORICAL, ID, LABEL, NUMERIC, PROBABILITY, SchemaError
from keepwise.session import fits_at_once, table_path

FEATURES_COL = "features"
WEIGHT = "weight"
PARTITION_ROWS = 50_000  # rows a task of a fit reads


def preprocessing() -> list:
    """Impute and scale numerics, impute and one-hot encode categories, assemble one vector.

    Every known level keeps its column; an unseen level gives zeros, since the encoder drops
    the extra category that the indexer keeps for it.
    """
    filled = [f"{c}_filled" for c in CATEGORICAL]
    indexed = [f"{c}_index" for c in CATEGORICAL]
    encoded = [f"{c}_levels" for c in CATEGORICAL]
    scaled = [f"{c}_scaled" for c in NUMERIC]
    return [
        NumericScaler(inputCols=NUMERIC, outputCols=scaled),
        ModeImputer(inputCols=CATEGORICAL, outputCols=filled),
        StringIndexer(
            inputCols=filled, outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"
        ),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=scaled + encoded, outputCol=FEATURES_COL),
    ]


def training_stages() -> list:
    return [*preprocessing(), BalancedWeights(labelCol=LABEL, weightCol=WEIGHT)]


def feature_names(model: PipelineModel) -> list[str]:
    """Names of the vector's entries: the numeric columns, then column_level."""
    indexer = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    levels = zip(CATEGORICAL, indexer.labelsArray, strict=True)
    return NUMERIC + [f"{column}_{level}" for column, labels in levels for level in labels]


@dataclass(frozen=True)
class Candidate:
    """A model family: how to build it from parameters and row count, and its grid.

    ``nested`` names parameters whose smaller values a model fitted with the largest one contains,
    ``nested_up`` those whose larger values one fitted with the smallest contains; ``sizes`` says which part of it a setting is.
    """

    name: str
    build: Callable[[dict, int], Estimator]
    grid: dict[str, list]
    nested: tuple[str, ...] = ()
    nested_up: tuple[str, ...] = ()
    sizes: Callable[[dict], tuple[int, int, int]] | None = None

    def settings(self) -> list[dict]:
        return [dict(zip(self.grid, values, strict=True)) for values in product(*self.grid.values())]

    def fits(self) -> list[tuple[dict, list[int]]]:
        """Parameters to fit with, each with the numbers of the settings it serves."""
        served: dict[tuple, list[int]] = {}
        for number, setting in enumerate(self.settings()):
            served.setdefault(tuple(v for k, v in setting.items() if k not in self.nested + self.nested_up), []).append(number)
        settings = self.settings()
        widest = {k: max(self.grid[k]) for k in self.nested} | {k: min(self.grid[k]) for k in self.nested_up}
        return [(settings[numbers[0]] | widest, numbers) for numbers in served.values()]


_COLUMNS = {"featuresCol": FEATURES_COL, "labelCol": LABEL, "weightCol": WEIGHT}


def candidates(seed: int = SEED) -> list[Candidate]:
    """The three families with their grids.

    Logistic regression: C becomes regParam = 1 / (C * n), the total balanced weight being n.
    """

    def logistic(params, n):
        return LogisticRegression(
            regParam=1.0 / (params["C"] * n), standardization=False, maxIter=2000, **_COLUMNS
        )

    def trees(params, _):
        return HistogramTrees(
            trees=params.get("n_estimators", 1),
            maxDepth=params["max_depth"],
            maxFeatures=str(params.get("max_features", "all")),
            minSplit=params["min_samples_split"],
            bagging="n_estimators" in params,
            seed=seed,
            idCol=ID,
            **_COLUMNS,
        )

    def sizes(params):
        return params.get("n_estimators", 1), params["max_depth"], params["min_samples_split"]

    # Model names and grids.
    return [
        Candidate("Logistisk regression", logistic, {"C": [0.01, 0.1, 1, 10]}),
        Candidate("Beslutsträd", trees, {"max_depth": [3, 5, 8], "min_samples_split": [2, 20, 50]}, ("max_depth",), ("min_samples_split",), sizes),
        Candidate(
            "Random forest",
            trees,
            {
                "n_estimators": [100, 200],
                "max_depth": [5, 10],
                "max_features": ["sqrt", 0.5],
                "min_samples_split": [2, 20],
            },
            ("n_estimators", "max_depth"),
            ("min_samples_split",),
            sizes,
        ),
    ]


def laid_out(rows: DataFrame, n: int) -> DataFrame:
    """The rows in an order and in partitions that follow from the rows alone.

    Fits that draw per partition, such as forests, then give the same model however the input was
    partitioned, and small tables do not pay for many small tasks.
    """
    parts = max(1, -(-n // PARTITION_ROWS))
    key = F.xxhash64(ID)
    everything = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.repartition(parts, key).sortWithinPartitions(key, everything)


def positive_score(model: Model, rows: DataFrame, *kept: str) -> DataFrame:
    """(kept columns, churn_probability) without the columns that ranking does not need."""
    model = model.copy()
    if isinstance(model, LogisticRegressionModel):
        model = model.setRawPredictionCol("").setPredictionCol("")
    return model.transform(rows).select(*kept, vector_to_array(F.col("probability"))[1].alias(PROBABILITY))


def served_scores(family: Candidate, model: Model, rows: DataFrame, served: list[tuple[int, dict]]) -> DataFrame:
    """(label, churn_probability, setting) of all settings that a fitted model serves, from one pass over the rows."""
    if family.sizes is None:
        (number, _), = served
        return positive_score(model, rows, LABEL).withColumn("setting", F.lit(number))
    chances = model.truncated_chances(rows.sparkSession, [family.sizes(setting) for _, setting in served])
    each = rows.select(LABEL, chances.alias("chances")).select(LABEL, F.posexplode("chances").alias("k", PROBABILITY))
    numbers = F.array(*[F.lit(number) for number, _ in served])
    return each.select(LABEL, PROBABILITY, F.get(numbers, F.col("k")).alias("setting"))


def binned_rows(estimators: list[Estimator], rows: DataFrame) -> Binned | None:
    """The rows in bins if one of the estimators grows trees; all of them share the bins."""
    growing = [e for e in estimators if isinstance(e, HistogramTrees)]
    return growing[0].binned(rows) if growing else None


def fit_on(estimator: Estimator, rows: DataFrame, binned: Binned | None) -> Model:
    return estimator.fit_binned(binned) if isinstance(estimator, HistogramTrees) else estimator.fit(rows)


def grid_scores(
    train: DataFrame,
    families: list[Candidate],
    folds: int = FOLDS,
    seed: int = SEED,
    parallelism: int = 8,
) -> DataFrame:
    """(setting, fold, roc_auc) of every grid point, numbered in the order of the families' grids.

    Preprocessing and class weights are learned inside each fold, once for the whole grid. The
    vectors of the folds under way stay cached while their models are fitted by parallel jobs;
    the row count decides how many folds and fits share the cluster, down to one. Rows are put in bins once a fold.
    Each fit writes the scores of its held-out rows by all settings it serves; all folds and settings are then ranked in one query.
    """
    spark = train.sparkSession
    kept = [ID, *NUMERIC, *CATEGORICAL, LABEL]
    rows = train.count()
    folded = laid_out(with_folds(train.select(*kept), folds, seed), rows).persist(StorageLevel.MEMORY_AND_DISK)
    tasks, first_number = [], 0
    for family in families:
        settings = family.settings()
        tasks += [(family, fitted, [(first_number + k, settings[k]) for k in numbers]) for fitted, numbers in family.fits()]
        first_number += len(settings)
    path = table_path(spark, "held_scores", uuid.uuid4().hex)

    def prepare(fold: int):
        held = folded.withColumn("_held", F.col("fold") == fold)
        fitted = Pipeline(stages=training_stages()).fit(held.filter(~F.col("_held")))
        vectors = fitted.transform(held).select("_held", ID, LABEL, WEIGHT, FEATURES_COL)
        vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
        fit_rows = vectors.filter(~F.col("_held"))
        n = fit_rows.count()
        return fold, vectors, n, binned_rows([family.build(largest, n) for family, largest, _ in tasks], fit_rows)

    def run(task) -> None:
        (family, largest, served), (fold, vectors, n, binned) = task
        fitted = fit_on(family.build(largest, n), vectors.filter(~F.col("_held")), binned)
        scores = served_scores(family, fitted, vectors.filter(F.col("_held")), served)
        scores.write.mode("overwrite").parquet(f"{path}/fit={served[0][0]}/fold={fold}")

    def release(fold) -> None:
        _, vectors, _, binned = fold
        vectors.unpersist()
        if binned:
            binned.blocks.unpersist()

    prepared = []
    try:
        folds_at_once = fits_at_once(rows, folds)
        with ThreadPool(fits_at_once(rows, parallelism)) as pool:
            for first in range(0, folds, folds_at_once):
                prepared += in_parallel(pool, prepare, range(first, min(folds, first + folds_at_once)))
                # The longest fits are listed last; they start first, so that no core waits for them.
                in_parallel(pool, run, [(task, fold) for task in reversed(tasks) for fold in prepared])
                while prepared:
                    release(prepared.pop())
    finally:
        for fold in prepared:
            release(fold)
        folded.unpersist()
    held = spark.read.schema(f"{LABEL} double, {PROBABILITY} double, setting int, fit int, fold int").parquet(path)
    return roc_auc_by(held, ["setting", "fold"], LABEL)


def tune(
    train: DataFrame,
    families: list[Candidate],
    folds: int = FOLDS,
    seed: int = SEED,
    parallelism: int = 8,
) -> dict[str, tuple[dict, float]]:
    """Best parameters and mean fold AUC per family, by stratified cross-validation.

    On equal means the earlier grid point wins; a fold whose held-out rows have one class cannot be ranked.
    """
    scores = grid_scores(train, families, folds, seed, parallelism)
    means = {r.setting: r.score for r in scores.groupBy("setting").agg(F.avg("roc_auc").alias("score")).collect()}
    best: dict[str, tuple[dict, float]] = {}
    numbered = enumerate((family, setting) for family in families for setting in family.settings())
    for number, (family, setting) in numbered:
        score = means.get(number)
        if score is None:
            raise ValueError("no fold has held-out rows of both classes")
        if family.name not in best or score > best[family.name][1]:
            best[family.name] = (setting, score)
    return best


def in_parallel(pool: ThreadPool, work: Callable, items) -> list:
    """Run independent Spark jobs from driver threads; results in order."""
    spark = SparkSession.getActiveSession()
    return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)


def fit_pipelines(
    train: DataFrame, chosen: list[tuple[Candidate, dict]], parallelism: int = 8
) -> list[PipelineModel]:
    """Full pipelines for several (family, parameters) on the same rows.

    They share one fit of the preprocessing, one cached set of vectors and one of bins.
    """
    prepared = Pipeline(stages=training_stages()).fit(train)
    rows = laid_out(train.select(ID, *NUMERIC, *CATEGORICAL, LABEL), train.count())
    vectors = prepared.transform(rows).select(ID, LABEL, WEIGHT, FEATURES_COL)
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    binned = None
    try:
        n = vectors.count()
        estimators = [family.build(params, n) for family, params in chosen]
        binned = binned_rows(estimators, vectors)
        with ThreadPool(fits_at_once(n, parallelism)) as pool:
            fitted = in_parallel(pool, lambda estimator: fit_on(estimator, vectors, binned), estimators)
    finally:
        vectors.unpersist()
        if binned:
            binned.blocks.unpersist()
    return [PipelineModel([*prepared.stages, model]) for model in fitted]


# What a fitted classifier says about its columns: name of the figures and where they stand.
WEIGHTS = {
    LogisticRegressionModel: ("coefficient", "coefficients"),
    NodeTableModel: ("importance", "featureImportances"),
}


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(feature, value, kind) of every model column, largest absolute value first."""
    classifier = type(model.stages[-1])
    if classifier not in WEIGHTS:
        raise ValueError(f"no column weights are known for {classifier.__name__}")
    kind, attribute = WEIGHTS[classifier]
    vector = getattr(model.stages[-1], attribute).toArray().tolist()
    named = spark.createDataFrame(list(zip(feature_names(model), vector, strict=True)), "feature string, value double")
    return named.withColumn("kind", F.lit(kind)).orderBy(F.abs("value").desc(), "feature")


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.desc(F.abs("value")), "feature").limit(n)


def predict_proba(model: PipelineModel, df: DataFrame, check_empty: bool = True) -> DataFrame:
    """The input rows with churn_probability.

    Needs the raw feature columns in any order; a target or other columns pass through
    untouched. An empty input is rejected, unless it is a stream or ``check_empty`` is off.
    """
    check_columns(df, require_target=False)
    if check_empty and not df.isStreaming and df.isEmpty():
        raise SchemaError("the data set is empty")
    given = [c for c in df.columns if c != PROBABILITY]
    kept = F.struct(*[F.col(f"`{c}`") for c in given]).alias("_given")
    features = enrich(df.select(*given, kept)).select("_given", *NUMERIC, *CATEGORICAL)
    scored = model.transform(features)
    probability = vector_to_array(F.col("probability"))[1].alias(PROBABILITY)
    return scored.select("_given.*", probability)


def score_batch(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability and decision per customer; ranking and export are left to the caller."""
    scored = predict_proba(model, df)
    return scored.withColumn("predicted_churn", decision(F.col(PROBABILITY), threshold))


def rank_by_risk(scored: DataFrame, key: str = "customerID") -> DataFrame:
    return scored.orderBy(F.desc(PROBABILITY), key)


def flagged_count(scored: DataFrame) -> DataFrame:
    """How many of all scored customers are flagged."""
    return scored.agg(
        F.coalesce(F.sum(F.col("predicted_churn").cast("bigint")), F.lit(0)).alias("flaggade"),
        F.count("*").alias("kunder"),
    )


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    try:
        spark.read.text(f"{path}/metadata")
    except AnalysisException as error:
        raise FileNotFoundError(f"nothing saved as a model at {path}") from error
    return PipelineModel.load(path)
