"""Customer segments: k-means, choice of k, projection and profiles."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.functions import features as X
from keepwise.operators.kmeans import Clusters, Rows
from keepwise.operators.models import FEATURES_COL, preprocessing
from keepwise.operators.prepare import enrich
from keepwise.operators.quality import require_columns
from keepwise.operators.split import SEED
from keepwise.operators.stages import NumericScaler
from keepwise.schema import FEATURES, ID, TARGET

# Default number of segments, range tried.
DEFAULT_K = 4
K_RANGE = range(2, 9)
STARTS = 10


def cluster_vectors(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The input rows with features: all prepared ones, or only the given numeric ones, scaled.

    With ``columns`` nothing is imputed and a missing value fails the query.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    features = enrich(df.select("*", row)).select("_row", *FEATURES)
    if columns is None:
        stages = preprocessing()
    else:
        require_columns(features, *columns)
        scaled = [f"{c}_scaled" for c in columns]
        stages = [
            NumericScaler(inputCols=columns, outputCols=scaled, impute=False),
            VectorAssembler(inputCols=scaled, outputCol=FEATURES_COL, handleInvalid="error"),
        ]
    fitted = Pipeline(stages=stages).fit(features.drop("_row"))
    return fitted.transform(features).select("_row.*", FEATURES_COL)


def check_ks(ks: list[int]) -> None:
    for k in ks:
        if k < 2:
            raise ValueError(f"the number of segments must be at least 2, got {k}")


def best_kmeans(vectors: DataFrame, ks: list[int], seed: int = SEED, starts: int = STARTS) -> dict[int, Clusters]:
    """Per k the cheapest of several runs, the earliest on ties; all runs share their passes over the rows."""
    check_ks(ks)
    with Rows(vectors, ID, FEATURES_COL) as rows:
        return rows.cluster(ks, seed, starts)


def kmeans_scores(vectors: DataFrame, ks=K_RANGE, seed: int = SEED, starts: int = STARTS) -> DataFrame:
    """(k, inertia, silhouette) per number of segments; the silhouette is null where a single cluster was found."""
    check_ks(list(ks))
    with Rows(vectors, ID, FEATURES_COL) as rows:
        if rows.n < 3:
            raise ValueError("too few rows to cluster")
        found = rows.cluster(list(ks), seed, starts)
        scores = rows.silhouettes(found)
    table = [(k, float(found[k].cost), scores[k]) for k in ks]
    return vectors.sparkSession.createDataFrame(table, "k int, inertia double, silhouette double")


def silhouette(labelled: DataFrame, column: str = "segment") -> float:
    """Mean silhouette of all rows by squared Euclidean distance; it needs cluster sums only, no pairs."""
    return ClusteringEvaluator(featuresCol=FEATURES_COL, predictionCol=column).evaluate(labelled)


def projection(vectors: DataFrame, components: int = 2) -> tuple[PipelineModel, list[float]]:
    """Centred PCA and the share of variance each component explains."""
    centre = StandardScaler(withMean=True, withStd=False, inputCol=FEATURES_COL, outputCol="centred")
    model = Pipeline(stages=[centre, PCA(k=components, inputCol="centred", outputCol="pcs")]).fit(vectors)
    return model, [float(v) for v in model.stages[-1].explainedVariance]


def project(vectors: DataFrame, model: PipelineModel) -> DataFrame:
    """Add pc1, pc2, ..: each axis points so that its largest loading is positive."""
    axes = model.stages[-1].pc.toArray()
    signs = [1.0 if axes[np.abs(axes[:, i]).argmax(), i] >= 0 else -1.0 for i in range(axes.shape[1])]
    values = vector_to_array(F.col("pcs"))
    kept = vectors.columns
    coordinates = [(values[i] * s).alias(f"pc{i + 1}") for i, s in enumerate(signs)]
    return model.transform(vectors).select(*kept, *coordinates)


def fit_segments(
    vectors: DataFrame, k: int = DEFAULT_K, seed: int = SEED, starts: int = STARTS
) -> tuple[DataFrame, list[float]]:
    """The rows with segment, pc1 and pc2 added, and the explained variance shares.

    Labels are computed on the rows themselves, so nothing has to be joined back to them.
    """
    check_ks([k])
    cached = vectors.select(ID, FEATURES_COL).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = best_kmeans(cached, [k], seed, starts)[k]
        axes, explained = projection(cached)
    finally:
        cached.unpersist()
    labelled = model.label(vectors, "segment", FEATURES_COL)
    return project(labelled, axes).drop(FEATURES_COL), explained


def segment_profiles(df: DataFrame, rounded: bool = True) -> DataFrame:
    """Size, means, usual contract and churn share (given a target) per segment.

    ``df`` carries a segment column. The usual contract is the most frequent one, the lowest
    of several; it comes from (segment, contract) counts, which every task pre-aggregates.
    """
    require_columns(df, "segment", "Contract")
    data = enrich(df).withColumn("churn_flag", X.churn_flag()) if TARGET in df.columns else enrich(df)
    means = {
        "snitt_tenure": "tenure",
        "snitt_manadskostnad": "MonthlyCharges",
        "snitt_tillaggstjanster": "num_addon_services",
    }
    if TARGET in df.columns:
        means["churn_andel"] = "churn_flag"
    sums = []
    for name, column in means.items():
        value = F.col(column).cast("double")
        sums += [F.sum(value).alias(f"s_{name}"), F.count(value).alias(f"n_{name}")]
    counted = data.groupBy("segment", "Contract").agg(F.count("*").alias("n"), *sums)
    usual = F.min(F.when(F.col("Contract").isNotNull(), F.struct((-F.col("n")).alias("rank"), "Contract")))
    profile = (
        counted.filter(F.col("segment").isNotNull())
        .groupBy("segment")
        .agg(
            F.sum("n").alias("antal_kunder"),
            usual["Contract"].alias("vanligaste_avtal"),
            *[(F.sum(f"s_{name}") / F.sum(f"n_{name}")).alias(name) for name in means],
        )
    )

    def shown(name):
        return F.bround(name, 2).alias(name) if rounded else F.col(name)

    first = [c for c in means if c != "churn_andel"]
    last = [c for c in means if c == "churn_andel"]
    return profile.select(
        "segment",
        "antal_kunder",
        *[shown(c) for c in first],
        "vanligaste_avtal",
        *[shown(c) for c in last],
    ).orderBy("segment")


def extreme_segments(profiles: DataFrame) -> DataFrame:
    """One row: the segments with the highest and the lowest churn share."""
    return profiles.agg(
        F.max_by("segment", F.struct("churn_andel", -F.col("segment"))).alias("riskiest"),
        F.max("churn_andel").alias("riskiest_churn"),
        F.min_by("segment", F.struct("churn_andel", "segment")).alias("safest"),
        F.min("churn_andel").alias("safest_churn"),
    )
