"""Tables written once per application and read by every query that starts from them.

Cleaning writes a file that exploration and forecasting read; so do these queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.operators.features import feature_matrix, scale, split
from tillroll.plans.cleaning import clean_sales
from tillroll.sources.files import read_table, write_table
from tillroll.sources.star import raw_sales
from tillroll.staging import staging_path

_paths: dict[tuple[str, str, str], str] = {}


def _written(
    spark: SparkSession, folder: str, label: str, build: Callable[[], DataFrame], **options
) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, label)
    if key not in _paths:
        path = staging_path(spark, label)
        write_table(build(), path, **options)
        _paths[key] = path
    return read_table(spark, _paths[key])


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder, "cleaned", lambda: clean_sales(raw_sales(spark, folder)), even=False)


def scaled_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The feature matrix, split and scaled."""
    return _written(
        spark,
        folder,
        "matrix",
        lambda: scale(split(feature_matrix(cleaned(spark, folder)))),
        partition_by=None,
    )
