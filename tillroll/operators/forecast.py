"""Regression models of monthly sales and their evaluation, on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.numeric import ratio
from tillroll.operators.features import (
    FEATURES, KEYS, SERIES, TARGET, add_seasons, fold_number,
)

# Model names and parameters.
LINEAR, RIDGE, BOOSTED = "Linear Regression", "Ridge Regression", "Gradient Boosting"
NAIVE = "Mean of three months"
ALPHA = 1.0
BOOSTING = {"maxIter": 200, "stepSize": 0.05, "maxDepth": 4, "seed": 42}
FOLDS = 5
# A quick variant: nodes of ten rows or more, so that no two inputs cut a node alike by chance.
FEW_ROUNDS = {"maxIter": 5, "stepSize": 0.3, "maxDepth": 4, "seed": 42, "minInstancesPerNode": 10}

SCALED = [f"{c}_sc" for c in FEATURES]


class RidgeRegression(
    Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable,
    DefaultParamsWritable,
):
    """Least squares plus ``alpha`` times the squared coefficients; the intercept is free.

    Spark divides the squared error by the row count and scales the penalty by the
    label's deviation, so ``alpha`` is converted for the rows it is fitted on.
    """

    alpha = Param(Params._dummy(), "alpha", "weight of the penalty", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, alpha=ALPHA, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(alpha=ALPHA)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> Model:
        label = self.getLabelCol()
        rows, spread = dataset.agg(F.count(label), F.stddev_pop(label)).first()
        return LinearRegression(
            featuresCol=self.getFeaturesCol(),
            labelCol=label,
            regParam=self.getOrDefault(self.alpha) * spread / rows,
            elasticNetParam=0.0,
            standardization=False,
            solver="normal",
        ).fit(dataset)


def estimators(boosting: dict = BOOSTING) -> dict[str, Estimator]:
    """The models compared: the linear ones on scaled features, boosting on raw ones."""
    return {
        LINEAR: LinearRegression(
            featuresCol="scaled", labelCol=TARGET, regParam=0.0, solver="normal",
            # The inputs hold their own sum, so Spark goes on from the sums of products step by step.
            maxIter=1000, tol=1e-14,
        ),
        RIDGE: RidgeRegression(alpha=ALPHA, featuresCol="scaled", labelCol=TARGET),
        BOOSTED: GBTRegressor(
            featuresCol="features", labelCol=TARGET, maxBins=128, **boosting
        ),
    }


def assemble(scaled_matrix: DataFrame) -> DataFrame:
    """The split and scaled matrix with feature vectors and fold numbers."""
    plain = VectorAssembler(inputCols=FEATURES, outputCol="features")
    scaled = VectorAssembler(inputCols=SCALED, outputCol="scaled")
    both = scaled.transform(plain.transform(scaled_matrix))
    return both.withColumn("fold", fold_number(FOLDS))


def metrics(
    predicted: DataFrame, *by: str, actual: str = TARGET, prediction: str = "prediction"
) -> DataFrame:
    """r2, mae and rmse of the predictions (for each group of ``by``), from one pass."""
    error = F.col(actual) - F.col(prediction)
    squared = F.avg(error * error)
    return predicted.groupBy(*by).agg(
        (1 - ratio(squared, F.var_pop(actual))).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(squared).alias("rmse"),
    )


def naive(scaled_matrix: DataFrame) -> DataFrame:
    """Each row predicted by the mean of the three months before it."""
    return scaled_matrix.withColumn("prediction", F.col("rolling_3avg"))


@dataclass
class Fitted:
    name: str
    model: Model
    predicted: DataFrame
    cv_r2: float | None = None


def fit(name: str, data: DataFrame, boosting: dict = BOOSTING) -> Fitted:
    """Fit one model on the training rows and predict the test rows."""
    train = data.where("not is_test").persist()
    model = estimators(boosting)[name].fit(train)
    train.unpersist()
    return Fitted(name, model, model.transform(data.where("is_test")))


def fit_with_folds(name: str, data: DataFrame, boosting: dict = BOOSTING) -> Fitted:
    """Like ``fit``, plus the mean R² over the folds of the training rows.

    The folds do not depend on each other, so they are fitted side by side.
    """
    train = data.where("not is_test").persist()

    def fold_r2(fold: int) -> float:
        model = estimators(boosting)[name].fit(train.where(F.col("fold") != fold))
        return metrics(model.transform(train.where(F.col("fold") == fold))).first()["r2"]

    def work(fold: int | None):
        return estimators(boosting)[name].fit(train) if fold is None else fold_r2(fold)

    with ThreadPool(FOLDS + 1) as pool:
        task = inheritable_thread_target(data.sparkSession)(work)
        model, *scores = pool.map(task, [None, *range(FOLDS)])
    train.unpersist()
    predicted = model.transform(data.where("is_test"))
    return Fitted(name, model, predicted, sum(scores) / FOLDS)


def pipeline(name: str, boosting: dict = BOOSTING) -> Pipeline:
    """A model that learns labels and scaling from the rows it is fitted on.

    Labels it has not seen come after the known ones. Scores are by the sample deviation.
    """
    numbered = {f"{c}_enc": f"{c}_place" for c in SERIES}
    # A sum is a plain number; boosting would cut an indexer's own column by sets of labels.
    plain = ", ".join(f"{c}_number + 0 AS {c}_place" for c in SERIES)
    stages = [
        StringIndexer(
            inputCols=SERIES, outputCols=[f"{c}_number" for c in SERIES], stringOrderType="alphabetAsc", handleInvalid="keep"
        ),
        SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__"),
        VectorAssembler(inputCols=[numbered.get(c, c) for c in FEATURES], outputCol="features"),
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        estimators(boosting)[name],
    ]
    return Pipeline(stages=stages)


def fit_inside_folds(name: str, matrix: DataFrame, boosting: dict = BOOSTING) -> Fitted:
    """Like ``fit_with_folds``, from the matrix before scaling: each fold learns its own labels and scores.

    Nothing of the rows a fold is judged on enters what it is fitted with.
    """
    train = matrix.where("not is_test").withColumn("fold", fold_number(FOLDS)).persist()
    validator = CrossValidator(
        estimator=pipeline(name, boosting), estimatorParamMaps=[{}], numFolds=FOLDS, foldCol="fold", parallelism=FOLDS,
        evaluator=RegressionEvaluator(labelCol=TARGET, metricName="r2"),
    )
    found = validator.fit(train)
    train.unpersist()
    model = found.bestModel
    return Fitted(name, model.stages[-1], model.transform(matrix.where("is_test")), found.avgMetrics[0])


ORIGINS, HORIZON = 5, 6


def rolling_origin(
    matrix: DataFrame, models: list[str], origins: int = ORIGINS, horizon: int = HORIZON, boosting: dict = BOOSTING
) -> DataFrame:
    """(model, origin, rows, r2, mae, rmse): each model as it would have done at earlier dates.

    A model learns, labels and scores included, from all months before an origin and is judged on the
    ``horizon`` months from it on. Origins lie a horizon apart, the last one a horizon before the
    end. ``NAIVE`` is the mean of the three months before. An origin without rows on either side has no row.
    """
    numbered = matrix.withColumn("_number", F.col("year") * 12 + F.col("month") - 1).persist()
    first, last = numbered.agg(F.min("_number"), F.max("_number")).first()
    starts = [] if last is None else [n for k in range(origins, 0, -1) if (n := last + 1 - k * horizon) > first]

    def judged(task: tuple[str, int]) -> DataFrame:
        name, start = task
        ahead = numbered.where(F.col("_number").between(start, start + horizon - 1))
        if name == NAIVE:
            predicted = naive(ahead)
        else:
            predicted = pipeline(name, boosting).fit(numbered.where(F.col("_number") < start)).transform(ahead)
        named = predicted.select(
            F.lit(name).alias("model"), F.lit(f"{start // 12:04d}-{start % 12 + 1:02d}").alias("origin"), TARGET, "prediction"
        )
        counted = named.groupBy("model", "origin").agg(F.count(F.lit(1)).alias("rows"))
        return counted.join(metrics(named, "model", "origin"), ["model", "origin"])

    tasks = [(name, start) for name in models for start in starts]
    with ThreadPool(FOLDS) as pool:
        found = pool.map(inheritable_thread_target(matrix.sparkSession)(judged), tasks)
    schema = "model string, origin string, rows long, r2 double, mae double, rmse double"
    # A row for each model and origin, which no longer needs the models.
    rows = [r for table in found for r in table.collect()]
    numbered.unpersist()
    return matrix.sparkSession.createDataFrame(rows, schema)


def comparison(models: list[Fitted]) -> DataFrame:
    """(model, r2, mae, rmse, cv_r2), one row per model in the given order."""
    rows = [
        metrics(m.predicted).select(
            F.lit(m.name).alias("model"), "r2", "mae", "rmse",
            F.lit(m.cv_r2).cast("double").alias("cv_r2"),
        )
        for m in models
    ]
    return reduce(DataFrame.unionByName, rows)


def best_of(models: list[Fitted], choose: str = "test") -> Fitted:
    """The model with the highest R² on the test rows (``choose="cv"``: over the folds), the first one on ties."""
    if choose not in ("test", "cv"):
        raise ValueError(f"choose must be 'test' or 'cv', not {choose!r}")
    if choose == "cv":
        return max(models, key=lambda m: m.cv_r2)
    r2 = {row["model"]: row["r2"] for row in comparison(models).collect()}
    return max(models, key=lambda m: r2[m.name])


def summary(best: Fitted) -> DataFrame:
    return comparison([best]).withColumnRenamed("model", "best_model")


def residuals(predicted: DataFrame) -> DataFrame:
    """(keys, actual, predicted, residual) of the test rows."""
    return predicted.select(
        *KEYS,
        F.col(TARGET).alias("actual"),
        F.col("prediction").alias("predicted"),
        (F.col(TARGET) - F.col("prediction")).alias("residual"),
    )


def perfect_line(predicted: DataFrame) -> DataFrame:
    """The range actual and predicted values span together."""
    return predicted.agg(
        F.least(F.min(TARGET), F.min("prediction")).alias("lowest"),
        F.greatest(F.max(TARGET), F.max("prediction")).alias("highest"),
    )


def importance(fitted: Fitted, spark: SparkSession) -> DataFrame:
    """(feature, importance, is_major), least important first.

    Linear models give the size of their coefficients, boosting its share of the
    gain; a feature is major from the median on.
    """
    model = fitted.model
    linear = isinstance(model, LinearRegressionModel)
    weights = model.coefficients if linear else model.featureImportances
    rows = [(f, abs(float(w))) for f, w in zip(FEATURES, weights.toArray())]
    table = spark.createDataFrame(rows, "feature string, importance double")
    middle = table.agg(F.median("importance")).scalar()
    return table.withColumn("is_major", F.col("importance") >= middle).orderBy(
        "importance", "feature"
    )


# Inputs known before a month begins; its own orders and discounts are not. The rolling mean adds
# nothing to the three lags it is the mean of, and without it the sums of products can be inverted.
KNOWN_AHEAD = [
    c for c in FEATURES if c not in ("avg_discount", "order_count", "avg_quantity", "rolling_3avg")
]


def next_month(matrix: DataFrame) -> DataFrame:
    """The features of the month after the last one, for every region and category that has rows in it.

    A series that ended earlier has no last months to go by and is left out.
    """
    number = F.col("year") * 12 + F.col("month") - 1
    history = F.struct(TARGET, "lag_1_sales", "lag_2_sales")
    upcoming = matrix.agg(F.max(number) + 1).scalar()
    latest = matrix.groupBy("region", "category", "region_enc", "category_enc").agg(
        F.max_by(history, number).alias("_h"), F.max(number).alias("_last")
    )
    dated = latest.where(F.col("_last") + 1 == upcoming).drop("_last").withColumn("_next", upcoming).select(
        "*",
        F.floor(F.col("_next") / 12).cast("int").alias("year"),
        (F.col("_next") % 12 + 1).cast("int").alias("month"),
        F.col(f"_h.{TARGET}").alias("lag_1_sales"),
        F.col("_h.lag_1_sales").alias("lag_2_sales"),
        F.col("_h.lag_2_sales").alias("lag_3_sales"),
    )
    quarter = F.ceil(F.col("month") / 3).cast("int")
    mean = (F.col("lag_1_sales") + F.col("lag_2_sales") + F.col("lag_3_sales")) / 3
    return add_seasons(dated.withColumns({"quarter": quarter, "rolling_3avg": mean})).drop(
        "_h", "_next"
    )


def forecast_bands(scaled_matrix: DataFrame, z: float = 1.96) -> DataFrame:
    """Next month's sales by region and category, z residual deviations either way.

    The model is linear, takes only inputs known ahead, and its deviation is that
    of the test rows.
    """
    assembler = VectorAssembler(inputCols=KNOWN_AHEAD, outputCol="features")
    data = assembler.transform(scaled_matrix)
    model = LinearRegression(labelCol=TARGET, solver="normal").fit(data.where("not is_test"))
    errors = model.transform(data.where("is_test")).select(
        (F.col(TARGET) - F.col("prediction")).alias("error")
    )
    spread = errors.agg(F.stddev_pop("error")).scalar()
    ahead = model.transform(assembler.transform(next_month(scaled_matrix)))
    return ahead.withColumn("_band", spread * z).select(
        "year",
        "month",
        *SERIES,
        F.col("prediction").alias("forecast"),
        (F.col("prediction") - F.col("_band")).alias("lower"),
        (F.col("prediction") + F.col("_band")).alias("upper"),
    )
