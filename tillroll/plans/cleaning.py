"""Raw order lines in, cleaned sales out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from tillroll.operators import cleaning, quality
from tillroll.schema import UNREADABLE
from tillroll.sources.files import read_raw, read_table, replace_years, write_table
from tillroll.staging import stage, temporary


def clean_sales(raw: DataFrame, k: float = 3.0, accuracy: int | None = None) -> DataFrame:
    """All cleaning steps in order, on canonical column names."""
    unique = stage(cleaning.drop_duplicates(cleaning.rename_columns(raw)), "unique")
    return clean_distinct(unique, k, accuracy)


def clean_distinct(
    unique: DataFrame, k: float = 3.0, accuracy: int | None = None
) -> DataFrame:
    """The steps after the duplicates are gone.

    ``unique`` is read for two sets of statistics and for the result. Staged, it
    costs its one wide shuffle once, and the statistics read only their columns.
    """
    return (
        unique.transform(cleaning.impute_numeric, accuracy=accuracy)
        .transform(cleaning.impute_categorical)
        .transform(cleaning.drop_null_dates)
        .transform(cleaning.fill_text)
        .transform(cleaning.standardise)
        .transform(cleaning.drop_nonpositive_sales)
        .transform(cleaning.numeric_rules)
        .transform(cleaning.cap_outliers, k=k, accuracy=accuracy)
        .transform(cleaning.drop_inverted_dates)
        .transform(cleaning.add_derived)
        .drop(UNREADABLE)
    )


def clean_with_report(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cleaned table and the quality report of the raw one.

    The raw rows are read and shuffled once, for the report and for cleaning.
    """
    distinct = stage(quality.distinct_rows(cleaning.rename_columns(raw)), "unique")
    cleaned = clean_distinct(distinct.drop(quality.COPIES))
    return cleaned, quality.report_of_distinct(distinct, "RAW")


def summarise(cleaned: DataFrame, before: DataFrame) -> DataFrame:
    after = quality.quality_report(cleaned, "CLEANED", duplicates=False)
    return quality.quality_summary(before, after)


class CleaningRun(NamedTuple):
    """What a run reports; a few rows each."""

    summary: DataFrame
    before: DataFrame  # quality reports
    after: DataFrame
    audit: DataFrame  # what each step changed
    unreadable: DataFrame  # cells that could not be read, by column


def run_cleaning(
    spark: SparkSession,
    source: str,
    target: str,
    format: str = "parquet",
    k: float = 3.0,
    unreadable: str = "raise",
    years: list[int] | None = None,
) -> CleaningRun:
    """Clean a raw CSV file into ``target`` and report on it.

    Cells that hold something other than a number or date: ``raise`` stops before anything is
    cleaned and says how many there are; ``keep`` leaves numbers null in the cleaned
    table; ``fill`` treats them as missing, so numbers get the median. Lines without a
    readable date are dropped by both, as lines without a date are. The raw rows are
    shuffled once, and the copy of them is deleted at the end.

    ``years`` replaces only these years of a target that is there already (Parquet). Medians,
    modes and limits are still those of all lines, and the reports tell of the whole target.
    """
    if years is not None and format != "parquet":
        raise ValueError("years can be replaced in Parquet tables only")
    if unreadable not in ("raise", "keep", "fill"):
        raise ValueError(f"unreadable must be 'raise', 'keep' or 'fill', not {unreadable!r}")
    with temporary(spark):
        raw = cleaning.rename_columns(read_raw(spark, source, unreadable="mark"))
        distinct = stage(quality.distinct_rows(raw), "unique")
        lost = _small(quality.unreadable_of_distinct(distinct))
        counts = {r["column"]: r["cells"] for r in lost.collect() if r["cells"]}
        if counts and unreadable == "raise":
            raise ValueError(f"cells that cannot be read, by column: {counts}")
        if unreadable == "fill":
            distinct = distinct.drop(UNREADABLE)
        cleaned = clean_distinct(distinct.drop(quality.COPIES), k)
        if years is None:
            write_table(cleaned, target, format, even=False)
        else:
            replace_years(cleaned, target, years)
        before = _small(quality.report_of_distinct(distinct, "RAW"))
        after = _small(quality.quality_report(read_table(spark, target, format), "CLEANED", stored=True))
        audit = _small(quality.audit_of_distinct(distinct, k))
        summary = _small(quality.quality_summary(before, after))
    return CleaningRun(summary, before, after, audit, lost)


def _small(df: DataFrame) -> DataFrame:
    """A report of a few rows, by its values, so that the tables it came from can go."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
