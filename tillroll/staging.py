"""Intermediate tables, written to the cluster's shared checkpoint folder.

A staged table is read back column by column, keeps one fixed content for every
consumer and does not need its producers again when an executor is lost.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_private: dict[str, str] = {}  # the temporary folder of each local application
_written: list[list[str]] = []  # what each open ``temporary`` has staged


def staging_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or _private.get(sc.applicationId)
    root = root or sc.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _private[sc.applicationId] = tempfile.mkdtemp(prefix="tillroll-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def _application_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, label: str) -> str:
    path = f"{_application_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was staged inside; tables read from it are gone then."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            delete(spark, path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete everything this application has staged; tables read from it are gone too."""
    delete(spark, _application_folder(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds; one that is not there is no fault."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(folder, True)
