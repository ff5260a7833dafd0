"""Calendar helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_years(day: Column, first: int, last: int | None = None) -> Column:
    """Days in the years first..last, as a half-open range the Parquet scan can prune on."""
    end = (first if last is None else last) + 1
    return (day >= F.lit(dt.date(first, 1, 1))) & (day < F.lit(dt.date(end, 1, 1)))


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def month_name(month: Column) -> Column:
    """1 -> Jan, 2 -> Feb, ..."""
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")


def fill_months(monthly: DataFrame, month: str, series: list[str], zeros: list[str]) -> DataFrame:
    """A row for every month from the first to the last one of each series.

    ``month`` holds first days of months, one row to a month and series; rows without one stay as they
    are. In the rows added, ``zeros`` are zero and all other columns null, ``series`` apart.
    Each row brings the months up to the next one along, so nothing is joined.
    """
    following = F.lead(month).over(Window.partitionBy(*series).orderBy(month))
    until = F.coalesce(F.add_months(following, -1), F.col(month))
    spread = monthly.withColumn("_until", until).withColumn(
        "_at", F.explode_outer(F.expr(f"sequence({month}, _until, interval 1 month)"))
    )
    own = F.col("_at").eqNullSafe(F.col(month))
    filled = {
        f.name: F.when(own, F.col(f.name)).otherwise(F.lit(0).cast(f.dataType) if f.name in zeros else None)
        for f in monthly.schema.fields
        if f.name not in (*series, month)
    }
    return spread.withColumns(filled).withColumn(month, F.col("_at")).drop("_at", "_until")
