"""Global row numbers, ranks and n-tiles without a single-partition window.

Rows are range-partitioned on the sort order and staged, so that each row's
partition number is settled. Inside a partition ordinary windows count; between
partitions one summary row each (as many as ``spark.sql.shuffle.partitions``)
carries the counts forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.staging import stage

PART = "_part"


def range_parts(df: DataFrame, *order: Column | str, label: str = "ranges") -> DataFrame:
    """``df`` range-partitioned on ``order`` and staged, with its partition number."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(
        df.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()), label
    )


def ntile_of(row_number: Column, total: Column, buckets: int) -> Column:
    """The NTILE bucket of the given 1-based row number: earlier buckets take the remainder."""
    small = F.floor(total / buckets)
    extra = total % buckets
    wide_rows = extra * (small + 1)
    in_wide = F.ceil(row_number / (small + 1))
    in_small = extra + F.ceil(F.try_divide(row_number - wide_rows, small))
    return F.when(row_number <= wide_rows, in_wide).otherwise(in_small).cast("int")


def rank_all(
    df: DataFrame,
    value: str,
    ties: list[str],
    buckets: int,
    rank_name: str,
    ntile_name: str,
) -> DataFrame:
    """RANK and NTILE over all rows by ``value`` descending; ``ties`` settles the row order."""
    order = [F.col(value).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    parts = range_parts(df, *order)
    in_part = Window.partitionBy(PART)
    local = parts.withColumns(
        {
            "_row": F.row_number().over(in_part.orderBy(*order)),
            "_rank": F.rank().over(in_part.orderBy(order[0])),
        }
    )
    # Equal values may run over a partition boundary. They are then the last
    # value of the partition they start in, whose rank holds for all of them.
    summary = local.groupBy(PART).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max_by(value, "_row").alias("_last"),
        F.min_by(value, "_row").alias("_first"),
        F.max("_rank").alias("_last_rank"),
    )
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumns(
        {
            "_offset": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
            "_total": F.sum("_rows").over(
                Window.orderBy(PART).rowsBetween(
                    Window.unboundedPreceding, Window.unboundedFollowing
                )
            ),
        }
    )
    same_last = Window.partitionBy("_last").orderBy(PART)
    begun = summary.select(
        F.col("_last").alias("_value"),
        (F.col("_offset") + F.col("_last_rank")).alias("_begun_rank"),
        F.col(PART).alias("_begun"),
        F.row_number().over(same_last).alias("_n"),
    ).where("_n = 1")
    summary = summary.join(
        begun,
        F.col("_first").eqNullSafe(F.col("_value")) & (F.col("_begun") < F.col(PART)),
        "left",
    ).select(PART, "_offset", "_total", "_first", "_begun_rank")
    row = F.col("_offset") + F.col("_row")
    carried = F.col(value).eqNullSafe(F.col("_first")) & F.col("_begun_rank").isNotNull()
    rank = F.when(carried, F.col("_begun_rank")).otherwise(F.col("_offset") + F.col("_rank"))
    # The summary has one row per partition, so it is broadcast.
    return local.join(F.broadcast(summary), PART).select(
        *df.columns,
        ntile_of(row, F.col("_total"), buckets).alias(ntile_name),
        rank.cast("bigint").alias(rank_name),
    )


def top_ranked(
    df: DataFrame, value: str, ties: list[str], k: int, rank_name: str
) -> DataFrame:
    """The k rows with the highest value and their RANK.

    Every row that ranks above one of the k is itself among the k, so ranking
    the k rows gives the global ranks.
    """
    order = [F.col(value).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    return df.orderBy(*order).limit(k).withColumn(
        rank_name, F.rank().over(Window.orderBy(order[0])).cast("bigint")
    )
