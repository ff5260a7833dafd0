"""What a table's quality is, and what cleaning changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import half_even, ratio
from tillroll.operators import cleaning
from tillroll.schema import CATEGORICAL, DATES, FAULTS, NUMERIC, UNREADABLE
from tillroll.staging import stage


COPIES = "_copies"
_HASH = "_hash"


def distinct_rows(df: DataFrame) -> DataFrame:
    """Each different row once, with the number of its copies.

    Copies are counted where they are read, so however many there are of a row,
    every task sends it on once.
    """
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))


def report_of_distinct(distinct: DataFrame, label: str) -> DataFrame:
    """The quality report of the table that ``distinct_rows`` was taken from."""
    columns = [c for c in distinct.columns if c not in (COPIES, UNREADABLE)]
    missing = [F.sum(F.when(F.col(c).isNull(), F.col(COPIES)).otherwise(0)) for c in columns]
    return distinct.agg(
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("rows"),
        (F.coalesce(F.sum(COPIES), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_rows"),
        F.array(*[F.coalesce(m, F.lit(0)) for m in missing]).alias("_missing"),
    ).select(
        F.lit(label).alias("stage"),
        "rows",
        F.lit(len(columns)).alias("columns"),
        F.aggregate("_missing", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total_missing"),
        "duplicate_rows",
        F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), "_missing").alias(
            "missing_per_col"
        ),
    )


def surplus_copies(stored: DataFrame) -> DataFrame:
    """One row ``duplicate_rows``: how many rows are copies of others.

    Rows with a hash of their own have no copy; only the others are compared, and only
    hashes are shuffled to find them. The table is read twice.
    """
    hashed = stored.withColumn(_HASH, F.xxhash64(*stored.columns))
    # Staged, so that Spark knows how many there are before it joins.
    repeated = stage(hashed.groupBy(_HASH).count().where("count > 1").select(_HASH), "repeated")
    some = distinct_rows(hashed.join(repeated, _HASH, "left_semi"))
    return some.agg(F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("duplicate_rows"))


def quality_report(df: DataFrame, label: str, duplicates: bool = True, stored: bool = False) -> DataFrame:
    """One row: rows, columns, missing values (in all and by column) and surplus copies.

    Counting copies shuffles whole rows once, or hashes of them if ``df`` is ``stored`` and so can be
    read again at little cost; without ``duplicates`` (null then) nothing is shuffled.
    """
    if duplicates and not stored:
        return report_of_distinct(distinct_rows(df), label)
    if duplicates:
        report = report_of_distinct(df.withColumn(COPIES, F.lit(1)), label)
        return report.withColumn("duplicate_rows", surplus_copies(df).scalar())
    report = report_of_distinct(df.withColumn(COPIES, F.lit(1)), label)
    return report.withColumn("duplicate_rows", F.lit(None).cast("bigint"))


def unreadable_cells(marked: DataFrame) -> DataFrame:
    """(column, cells): how many cells of each number and date column could not be read, and
    how many lines had each of ``FAULTS``."""
    return unreadable_of_distinct(marked.withColumn(COPIES, F.lit(1)))


def unreadable_of_distinct(distinct: DataFrame) -> DataFrame:
    """The unreadable cells of the table that ``distinct_rows`` was taken from."""
    found = [
        F.coalesce(F.sum(F.when(F.array_contains(UNREADABLE, c), F.col(COPIES))), F.lit(0))
        for c in DATES + NUMERIC + FAULTS
    ]
    table = [
        F.struct(F.lit(c).alias("column"), n.alias("cells"))
        for c, n in zip(DATES + NUMERIC + FAULTS, found, strict=True)
    ]
    return distinct.agg(F.array(*table).alias("_table")).select(F.inline("_table"))


def missing_by_column(report: DataFrame) -> DataFrame:
    """A quality report's missing values as (stage, column, missing) rows."""
    return report.select("stage", F.explode("missing_per_col").alias("column", "missing"))


def quality_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row comparing the quality reports of a table before and after cleaning."""
    b = before.select(F.struct("rows", "total_missing", "duplicate_rows")).scalar()
    both = after.withColumn("_before", b)
    missing_before, missing_after = F.col("_before.total_missing"), F.col("total_missing")
    gain = ratio(missing_before - missing_after, F.greatest(missing_before, F.lit(1))) * 100
    return both.select(
        F.col("_before.rows").alias("rows_before"),
        F.col("rows").alias("rows_after"),
        (F.col("_before.rows") - F.col("rows")).alias("rows_removed"),
        missing_before.alias("missing_before"),
        missing_after.alias("missing_after"),
        half_even(gain, 1).alias("accuracy_gain"),
        F.col("_before.duplicate_rows").alias("duplicate_rows_removed"),
    )


def cleaning_audit(raw: DataFrame, k: float = 3.0) -> DataFrame:
    """(step, column, affected): what each cleaning step finds to change, in step order."""
    return audit_of_distinct(stage(distinct_rows(raw), "unique"), k)


def audit_of_distinct(unique: DataFrame, k: float = 3.0) -> DataFrame:
    """The audit of the table that ``distinct_rows`` was taken from.

    ``unique`` should be staged: besides the statistics, one aggregate over it counts every step.
    """
    absent = {f"_no_{c}": cleaning.absent(unique, c) for c in NUMERIC + CATEGORICAL}
    lines = cleaning.impute_numeric(unique.withColumns(absent), ["sales"])
    kept = cleaning.drop_nonpositive_sales(cleaning.drop_null_dates(lines))
    lower, upper = cleaning.sales_bounds(kept, k)

    dated = F.col("order_date").isNotNull() & F.col("ship_date").isNotNull()
    nonpositive = F.coalesce(F.col("sales") <= 0, F.lit(False))
    outside = (F.col("sales") < F.lit(lower)) | (F.col("sales") > F.lit(upper))
    counts = [
        ("drop_duplicates", "*", F.sum(F.col(COPIES) - 1)),
        ("repeated_orders", "order_id", cleaning.repeated_orders(unique).scalar()),
        *[("fill_median", c, F.count_if(f"_no_{c}")) for c in NUMERIC],
        *[("fill_mode", c, F.count_if(f"_no_{c}")) for c in CATEGORICAL],
        ("drop_null_dates", "*", F.count_if(~dated)),
        ("drop_nonpositive_sales", "sales", F.count_if(dated & nonpositive)),
        ("cap_outliers", "sales", F.count_if(dated & ~nonpositive & outside)),
        (
            "drop_inverted_dates",
            "ship_date",
            F.count_if(dated & ~nonpositive & (F.col("ship_date") < F.col("order_date"))),
        ),
    ]
    table = [
        F.struct(F.lit(s).alias("step"), F.lit(c).alias("column"), n.alias("affected"))
        for s, c, n in counts
    ]
    return lines.agg(F.array(*table).alias("_table")).select(F.inline("_table"))
