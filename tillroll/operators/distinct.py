"""Exact distinct counts that can be stored and merged: bitmaps of numeric ids, in buckets.

A bitmap holds one bit for each of 32,768 neighbouring ids. Bitmaps of one key are joined by OR, so
counts over months, regions or both come from the stored rows, and a new month only adds its own.
They are built where the lines are read; what is shuffled are bitmaps by key and bucket, not ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_bitmaps(df: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Rows ``keys, counted, bucket, bits``: which ids of each column in ``ids`` occur with the keys.

    Ids are whole numbers, as numbers or text; any other text is an error. Null ids are not counted, null
    keys are keys of their own. Best for ids that are dense within a key, since a bitmap has 4 KB.
    """
    n, which = len(ids), F.pmod("_code", F.lit(len(ids)))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).cast("long").alias("id")) for i, c in enumerate(ids)]))
    rows = df.select(*keys, each.alias("_one")).select(*keys, "_one.which", "_one.id").where("id is not null")
    # Rows are sorted where they are read: one number for column and bucket keeps them small.
    coded = rows.select(*keys, (F.bitmap_bucket_number("id") * n + F.col("which")).alias("_code"), "id")
    maps = coded.groupBy(*keys, "_code").agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    counted = F.element_at(F.array(*[F.lit(c) for c in ids]), (which + 1).cast("int"))
    bucket = F.expr(f"(_code - pmod(_code, {n})) div {n}")
    return maps.select(*keys, counted.alias("counted"), bucket.alias("bucket"), "bits")


def merge_bitmaps(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """The bitmaps over fewer keys, or of several tables with the same columns in a union."""
    return bitmaps.groupBy(*keys, "counted", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count_bitmaps(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``keys, counted, n``: the exact distinct counts over ``keys``. Nothing stored, no row."""
    size = F.bitmap_count("bits")
    return merge_bitmaps(bitmaps, keys).groupBy(*keys, "counted").agg(F.sum(size).alias("n"))
