"""Features, models and dashboard tables as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.written import cleaned, scaled_matrix
from tillroll.operators import dashboard, features, forecast
from tillroll.operators.forecast import Fitted
from tillroll.sources.star import sales_table

CURRENT, PRIOR = 2000, 1999

# Averages of doubles differ in the last digits with the order of addition.
ROUNDED = {
    "avg_discount": 9, "avg_quantity": 9, "avg_profit_margin": 6, "rolling_3avg": 4,
    "r2": 9, "mae": 4, "rmse": 4, "cv_r2": 9, "predicted": 4, "residual": 4, "lowest": 4, "highest": 4,
    "importance": 4, "forecast": 1, "lower": 1, "upper": 1,
}
# Inputs that hold their own sum cost least squares some digits.
COARSE = ROUNDED | {"r2": 7, "mae": 2, "rmse": 2, "cv_r2": 7, "predicted": 0, "residual": 0}
FEW = {"r2": 6, "mae": 1, "rmse": 1, "cv_r2": 6, "predicted": 1, "residual": 1}
MEASURES = ["total_sales", "avg_discount", "order_count", "avg_quantity", "avg_profit_margin"]


def _shown(df: DataFrame, *columns: str, places: dict[str, int] = ROUNDED) -> DataFrame:
    names = columns or df.columns
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else c for c in names])


def _places(model: str) -> dict[str, int]:
    return COARSE if model == forecast.LINEAR else ROUNDED


def _with_gaps(monthly: DataFrame) -> DataFrame:
    """Some months are missing, other ones for regions with names of other lengths."""
    return monthly.where((F.col("year") * 12 + F.col("month") + F.length("region")) % 7 != 3)


def _scaled(spark: SparkSession, folder: str) -> DataFrame:
    table = scaled_matrix(spark, folder)
    scores = [F.round(c, 6).alias(c) for c in forecast.SCALED]
    return table.select(*features.KEYS, "is_test", *scores)


def _on_sales(table, **params):
    return lambda spark, folder: table(sales_table(spark, folder), **params)


_fitted: dict[tuple[str, str, str, bool], Fitted] = {}


def fitted(spark: SparkSession, folder: str, name: str, folds: bool = False) -> Fitted:
    """A model, fitted once per application and shared by the tables drawn from it."""
    key = (spark.sparkContext.applicationId, folder, name)
    if (*key, True) in _fitted:
        return _fitted[(*key, True)]
    if (*key, folds) not in _fitted:
        data = forecast.assemble(scaled_matrix(spark, folder))
        train = forecast.fit_with_folds if folds else forecast.fit
        _fitted[(*key, folds)] = train(name, data)
    return _fitted[(*key, folds)]


def _few_rounds(spark: SparkSession, folder: str, folds: bool = False) -> Fitted:
    """Boosting on averages without the digits that depend on the order of addition: a cut may fall on them."""
    matrix = scaled_matrix(spark, folder)
    averages = {c: F.round(c, ROUNDED[c]) for c in features.FEATURES if c in ROUNDED}
    train = forecast.fit_with_folds if folds else forecast.fit
    return train(forecast.BOOSTED, forecast.assemble(matrix.withColumns(averages)), forecast.FEW_ROUNDS)


def _few_rounds_models(spark: SparkSession, folder: str) -> list[Fitted]:
    linear = [fitted(spark, folder, name, True) for name in (forecast.LINEAR, forecast.RIDGE)]
    return [*linear, _few_rounds(spark, folder, True)]


def _inside_folds(spark: SparkSession, folder: str) -> DataFrame:
    matrix = scaled_matrix(spark, folder).drop(*forecast.SCALED)
    averages = {c: F.round(c, ROUNDED[c]) for c in features.FEATURES if c in ROUNDED}
    models = [forecast.fit_inside_folds(name, matrix, forecast.FEW_ROUNDS) for name in (forecast.LINEAR, forecast.RIDGE)]
    models += [forecast.fit_inside_folds(forecast.BOOSTED, matrix.withColumns(averages), forecast.FEW_ROUNDS)]
    return forecast.comparison(models).select("model", "cv_r2")


def _rolling_origin(spark: SparkSession, folder: str) -> DataFrame:
    matrix = scaled_matrix(spark, folder).drop(*forecast.SCALED)
    return forecast.rolling_origin(matrix, [forecast.LINEAR, forecast.RIDGE, forecast.NAIVE])


def _all(spark, folder, folds=False) -> list[Fitted]:
    return [fitted(spark, folder, name, folds) for name in forecast.estimators()]


def _predictions(name):
    return lambda spark, folder: _shown(
        forecast.residuals(fitted(spark, folder, name).predicted), places=_places(name)
    )


def _quality(name):
    return lambda spark, folder: _shown(
        forecast.comparison([fitted(spark, folder, name, True)]), places=_places(name)
    )


def _of_best(table):
    return lambda spark, folder: table(forecast.best_of(_all(spark, folder)))


QUERIES = {
    "feature_monthly": lambda spark, folder: _shown(
        features.monthly_features(cleaned(spark, folder)), *features.KEYS, *MEASURES
    ),
    "feature_lags": lambda spark, folder: _shown(
        features.add_lags(features.monthly_features(cleaned(spark, folder))),
        *features.KEYS, "total_sales", *features.LAGS, "rolling_3avg",
    ),
    "feature_lags_of_calendar": lambda spark, folder: _shown(
        features.add_lags(_with_gaps(features.monthly_features(cleaned(spark, folder))), densify=True),
        *features.KEYS, "total_sales", "order_count", *features.LAGS, "rolling_3avg",
    ),
    "feature_matrix": lambda spark, folder: _shown(
        features.feature_matrix(cleaned(spark, folder))
    ),
    "train_test_split": lambda spark, folder: _shown(
        features.split(features.feature_matrix(cleaned(spark, folder))),
        *features.KEYS, "total_sales", "is_test",
    ),
    "scaled_features": _scaled,
    "forecast_metrics": lambda spark, folder: _shown(
        forecast.metrics(forecast.naive(scaled_matrix(spark, folder)), "is_test")
    ),
    "forecast_naive_metrics": lambda spark, folder: _shown(
        forecast.metrics(forecast.naive(scaled_matrix(spark, folder)).where("is_test"))
    ),
    "forecast_linear": _predictions(forecast.LINEAR),
    "forecast_ridge": _predictions(forecast.RIDGE),
    "forecast_gbt": _predictions(forecast.BOOSTED),
    "forecast_few_rounds": lambda spark, folder: _shown(
        forecast.residuals(_few_rounds(spark, folder).predicted), places=FEW
    ),
    "forecast_few_rounds_quality": lambda spark, folder: _shown(
        forecast.comparison([_few_rounds(spark, folder, True)]), places=FEW
    ),
    "forecast_few_rounds_comparison": lambda spark, folder: _shown(
        forecast.comparison(_few_rounds_models(spark, folder)), places=FEW
    ),
    "forecast_few_rounds_summary": lambda spark, folder: _shown(
        forecast.summary(forecast.best_of(_few_rounds_models(spark, folder))), places=FEW
    ),
    "forecast_inside_folds": lambda spark, folder: _shown(_inside_folds(spark, folder), places=FEW),
    "forecast_rolling_origin": lambda spark, folder: _shown(_rolling_origin(spark, folder), places=FEW),
    "forecast_linear_quality": _quality(forecast.LINEAR),
    "forecast_ridge_quality": _quality(forecast.RIDGE),
    "forecast_ridge_line": lambda spark, folder: _shown(
        forecast.perfect_line(fitted(spark, folder, forecast.RIDGE).predicted)
    ),
    "forecast_ridge_importance": lambda spark, folder: _shown(
        forecast.importance(fitted(spark, folder, forecast.RIDGE), spark)
    ),
    "forecast_residuals": _of_best(lambda best: forecast.residuals(best.predicted)),
    "forecast_perfect_line": _of_best(lambda best: forecast.perfect_line(best.predicted)),
    "forecast_importance": _of_best(
        lambda best: forecast.importance(best, best.predicted.sparkSession)
    ),
    "forecast_cv": lambda spark, folder: forecast.comparison(_all(spark, folder, True)).select(
        "model", "cv_r2"
    ),
    "forecast_comparison": lambda spark, folder: forecast.comparison(_all(spark, folder, True)),
    "forecast_summary": lambda spark, folder: forecast.summary(
        forecast.best_of(_all(spark, folder, True))
    ),
    "forecast_bands": lambda spark, folder: _shown(
        forecast.forecast_bands(scaled_matrix(spark, folder))
    ),
    "kpi_cards": _on_sales(dashboard.kpi_cards),
    "kpi_drill_cube": _on_sales(dashboard.drill_through),
    "monthly_year_compare": _on_sales(
        dashboard.monthly_year_compare, current=CURRENT, prior=PRIOR
    ),
}
