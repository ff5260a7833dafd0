"""Order lines and orders stored for the join between them: bucketed and sorted by order key.

Dimensions are joined once, when the two tables are written. A query then joins bucket with bucket, without a
shuffle of either side, whatever the size of the dimensions. A task reads its bucket in order and doesn't hold
it, so a bucket may be larger than memory. There are more buckets the more lines there are.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession

from tillroll.schema import CANONICAL_COLUMNS
from tillroll.sources import star


LINES = 500_000  # to a bucket, at most on average


def _write(df: DataFrame, key: str, name: str, path: str, buckets: int) -> None:
    # Dealt out as the buckets are, so that each bucket is one file, read without sorting it again.
    (
        df.repartition(buckets, key).sortWithinPartitions(key)
        .write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
        .option("path", path).saveAsTable(name)
    )


def write_layout(spark: SparkSession, folder: str, path: str, buckets: int, prefix: str = "by_order") -> None:
    """Write the tables ``<prefix>_lines`` and ``<prefix>_orders`` below ``path``, in ``buckets`` buckets or more.

    They are entered in the session's catalog, which knows the buckets; another application needs a
    catalog that lasts. A lost task is written again, as in any table.
    """
    buckets = max(buckets, ceil(star.read(spark, folder, "lineitem").count() / LINES))
    _write(star.lines_of_parts(spark, folder), "l_orderkey", f"{prefix}_lines", f"{path}/lines", buckets)
    _write(star.orders_of_customers(spark, folder), "o_orderkey", f"{prefix}_orders", f"{path}/orders", buckets)


def sales_of_layout(spark: SparkSession, prefix: str = "by_order") -> DataFrame:
    """``star.sales_table`` from the stored tables."""
    lines, orders = spark.table(f"{prefix}_lines"), spark.table(f"{prefix}_orders")
    # A merge join keeps both sides where they are; with a hint, small tables in tests do as large ones.
    return star.joined(lines, orders.hint("merge")).select(*CANONICAL_COLUMNS)
