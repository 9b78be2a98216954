"""Pipeline stages for what the built-in ones do differently: exact median and lowest mode
imputation, scaling by the population deviation, and balanced class weights.

All of them fit with aggregations and transform with plain column expressions, and they save
and load with the rest of a pipeline.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.operators.quality import level_counts
from keepwise.operators.quantiles import exact_quantiles


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    def with_params(self, **values):
        return self._set(**values)


class NumericScaler(Estimator, HasInputCols, HasOutputCols, _Stage):
    """Median imputation, then centring and division by the population deviation."""

    impute = Param(Params._dummy(), "impute", "fill missing values", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, impute=True):
        super().__init__()
        self._setDefault(impute=True)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> NumericScalerModel:
        columns = self.getInputCols()
        values = {c: F.col(c).cast("double") for c in columns}
        stats = df.agg(
            F.count("*").alias("rows"),
            *[F.count(v).alias(f"n_{c}") for c, v in values.items()],
            *[F.avg(v).alias(f"m_{c}") for c, v in values.items()],
            *[F.var_pop(v).alias(f"v_{c}") for c, v in values.items()],
        ).first()
        medians = {}
        if self.getOrDefault(self.impute):
            totals = {c: stats[f"n_{c}"] for c in columns}
            medians = {c: q[0] for c, q in exact_quantiles(df, values, [0.5], totals=totals).items()}
        means, deviations = [], []
        for c in columns:
            fill = medians.get(c)
            known, mean, variance = stats[f"n_{c}"], stats[f"m_{c}"] or 0.0, stats[f"v_{c}"] or 0.0
            if fill is not None and known < stats["rows"]:
                # Add the imputed rows, all equal to the median, to mean and variance.
                share = known / stats["rows"]
                centre = share * mean + (1 - share) * fill
                variance = share * (variance + (mean - centre) ** 2) + (1 - share) * (fill - centre) ** 2
                mean = centre
            means.append(mean)
            deviations.append(variance**0.5 or 1.0)
        return NumericScalerModel().with_params(
            inputCols=columns,
            outputCols=self.getOutputCols(),
            impute=self.getOrDefault(self.impute),
            medians=[medians.get(c) or 0.0 for c in columns],
            means=means,
            deviations=deviations,
        )


class NumericScalerModel(Model, HasInputCols, HasOutputCols, _Stage):
    impute = Param(Params._dummy(), "impute", "fill missing values", TypeConverters.toBoolean)
    medians = Param(Params._dummy(), "medians", "fill values", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "centres", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "scales", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        impute = self.getOrDefault(self.impute)
        stats = zip(
            self.getInputCols(),
            self.getOutputCols(),
            self.getOrDefault(self.medians),
            self.getOrDefault(self.means),
            self.getOrDefault(self.deviations),
            strict=True,
        )
        scaled = {}
        for source, target, median, mean, deviation in stats:
            value = F.col(source).cast("double")
            value = F.coalesce(value, F.lit(median)) if impute else value
            scaled[target] = (value - F.lit(mean)) / F.lit(deviation)
        return df.withColumns(scaled)


class ModeImputer(Estimator, HasInputCols, HasOutputCols, _Stage):
    """Fill missing categories with the most frequent one, the lowest of several."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        columns = self.getInputCols()
        counted = level_counts(df, columns).filter(F.col("value").isNotNull())
        first = F.min(F.struct((-F.col("n")).alias("rank"), "value"))
        modes = counted.groupBy("column").agg(first["value"].alias("mode"))
        found = {row["column"]: row["mode"] for row in modes.collect()}
        return ModeImputerModel().with_params(
            inputCols=columns,
            outputCols=self.getOutputCols(),
            modes=[found.get(c, "") for c in columns],
        )


class ModeImputerModel(Model, HasInputCols, HasOutputCols, _Stage):
    modes = Param(Params._dummy(), "modes", "fill values", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        triples = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.modes), strict=True)
        return df.withColumns(
            {target: F.coalesce(F.col(source).cast("string"), F.lit(mode)) for source, target, mode in triples}
        )


class BalancedWeights(Estimator, HasLabelCol, _Stage):
    """Weight n / (classes * n_class), learned on the rows the stage is fitted on."""

    weightCol = Param(Params._dummy(), "weightCol", "output column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol="label", weightCol="weight"):
        super().__init__()
        self._set(**self._input_kwargs)
        if not self.isSet(self.weightCol):
            self._set(labelCol="label", weightCol="weight")

    def _fit(self, df: DataFrame) -> BalancedWeightsModel:
        label = F.col(self.getLabelCol())
        counts = {cls: F.count_if(label == cls) for cls in (0.0, 1.0)}
        other = F.count_if(label.isNotNull() & ~label.isin(0.0, 1.0))
        *found, strange = df.agg(*counts.values(), other).first()
        if strange:
            raise ValueError(f"{strange} labels are neither 0 nor 1")
        present = {cls: n for cls, n in zip(counts, found, strict=True) if n}
        total = sum(present.values())
        return BalancedWeightsModel().with_params(
            labelCol=self.getLabelCol(),
            weightCol=self.getOrDefault(self.weightCol),
            classes=list(present),
            weights=[total / (len(present) * n) for n in present.values()],
        )


class BalancedWeightsModel(Model, HasLabelCol, _Stage):
    weightCol = Param(Params._dummy(), "weightCol", "output column", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "labels", TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "weight per label", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        """Rows to be scored carry no label and get no weight."""
        if self.getLabelCol() not in df.columns:
            return df
        weight = F.lit(None).cast("double")
        for cls, value in zip(self.getOrDefault(self.classes), self.getOrDefault(self.weights), strict=True):
            weight = F.when(F.col(self.getLabelCol()) == cls, F.lit(value)).otherwise(weight)
        return df.withColumn(self.getOrDefault(self.weightCol), weight)
