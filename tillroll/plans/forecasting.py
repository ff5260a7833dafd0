"""Cleaned sales in, compared models out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillroll.operators import forecast
from tillroll.operators.features import feature_matrix, scale, split
from tillroll.operators.forecast import Fitted
from tillroll.staging import stage


def run_forecasting(
    cleaned: DataFrame, boosting: dict = forecast.BOOSTING, inside_folds: bool = False, choose: str = "test"
) -> tuple[list[Fitted], Fitted]:
    """Build the features, fit and cross-validate every model; the models and the best one.

    Scores are those of all training rows, unless ``inside_folds`` has each fold learn its own.
    The best model is chosen by the test rows, or by the folds (``choose="cv"``).
    """
    matrix = split(feature_matrix(cleaned))
    if inside_folds:
        data = stage(matrix.hint("rebalance"), "matrix")
        models = [forecast.fit_inside_folds(name, data, boosting) for name in forecast.estimators()]
    else:
        data = forecast.assemble(stage(scale(matrix).hint("rebalance"), "matrix"))
        models = [forecast.fit_with_folds(name, data, boosting) for name in forecast.estimators()]
    return models, forecast.best_of(models, choose)
