"""A stored aggregate by day, region, category and segment that the dashboard is answered from.

It has a row for each combination that was sold, so its size goes with the calendar and the number
of groups, not with the order lines. Sums are decimal and exact. Distinct orders and customers are
kept beside it as bitmaps by year (``operators.distinct``), which need whole numbers as ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import dashboard
from tillroll.operators.distinct import count_bitmaps, distinct_bitmaps, merge_bitmaps
from tillroll.sources.files import write_table

KEYS = ["order_date", *dashboard.DRILL]
SUMS = ["sales", "profit", "quantity"]
IDS = ["order_id", "customer_id"]


def day_rollup(sales: DataFrame) -> DataFrame:
    """Rows ``KEYS, sales, profit, quantity, lines, year``; null keys are keys of their own."""
    sums = [F.sum(c).alias(c) for c in SUMS]
    grouped = sales.groupBy(*KEYS).agg(*sums, F.count(F.lit(1)).alias("lines"))
    return grouped.withColumn("year", F.year("order_date"))


def merge_rollups(rollups: DataFrame) -> DataFrame:
    """One row for each key of several rollups in a union, say of an old one and of new lines."""
    return rollups.groupBy(*KEYS, "year").agg(*[F.sum(c).alias(c) for c in (*SUMS, "lines")])


def year_bitmaps(sales: DataFrame) -> DataFrame:
    """Which order and customer numbers occur in each year."""
    return distinct_bitmaps(sales.withColumn("year", F.year("order_date")), ["year"], IDS)


def merge_year_bitmaps(bitmaps: DataFrame) -> DataFrame:
    return merge_bitmaps(bitmaps, ["year"])


def write_rollup(sales: DataFrame, path: str, replace: str = "all") -> None:
    """Write both tables below ``path``, in folders by year.

    ``replace="present"`` writes only the years that ``sales`` has rows of, which must be there as a
    whole; other years' files stay.
    """
    write_table(day_rollup(sales), f"{path}/days", replace=replace)
    write_table(year_bitmaps(sales), f"{path}/ids", replace=replace)


def read_rollup(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The rollup and the bitmaps."""
    return spark.read.parquet(f"{path}/days"), spark.read.parquet(f"{path}/ids")


def kpi_cards(rollup: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``dashboard.kpi_cards`` of the lines behind the two tables."""
    counts = count_bitmaps(bitmaps, [])

    def distinct(name: str):
        return F.coalesce(counts.where(F.col("counted") == name).select("n").scalar(), F.lit(0))

    months = rollup.withColumn("month", F.date_format("order_date", "yyyy-MM"))
    totals = {"total_orders": distinct("order_id"), "total_customers": distinct("customer_id")}
    return dashboard.cards_of(dashboard.card_sums(months, {}).withColumns(totals))


def drill_through(rollup: DataFrame) -> DataFrame:
    """``dashboard.drill_through`` of the lines behind the rollup."""
    return dashboard.drill_through(rollup, lines="lines")


def monthly_year_compare(rollup: DataFrame, current: int, prior: int) -> DataFrame:
    """``dashboard.monthly_year_compare`` of the lines behind the rollup; other years' folders are skipped."""
    years = rollup.where(F.col("year").isin(current, prior))
    return dashboard.monthly_year_compare(years, current, prior)
