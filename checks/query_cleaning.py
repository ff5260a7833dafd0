"""The quality and cleaning operators as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators import cleaning, quality
from tillroll.plans.cleaning import clean_sales, clean_with_report, summarise
from tillroll.schema import EXPECTED_COLUMNS, UNREADABLE
from tillroll.sources.files import read_raw, typed
from tillroll.sources.star import raw_sales
from tillroll.staging import stage, staging_path

ORDERS = 16384  # order numbers to a raw file


def _on_raw(step):
    return lambda spark, folder: step(raw_sales(spark, folder))


def _on_unique(step):
    """The step on staged distinct rows, which it reads for statistics and again for the result."""
    return lambda spark, folder: step(
        stage(cleaning.drop_duplicates(raw_sales(spark, folder)), "unique")
    )


def _cap(df):
    return cleaning.cap_outliers(stage(cleaning.drop_nonpositive_sales(df), "valid"))


def _as_text(raw: DataFrame) -> DataFrame:
    """The rows as a file would hold them, some cells written in ways that cannot be read."""
    k = F.col("order_id").cast("long")

    def date(c: str):
        us = F.date_format(c, "M/d/yyyy H:mm")
        return F.when(k % 29 == 1, us).when(k % 31 == 2, F.date_format(c, "dd-MMM-yyyy")).otherwise(F.col(c).cast("string"))

    def number(c: str, n: int):
        text = F.col(c).cast("string")
        return F.when(k % n == 3, F.concat(F.lit("$"), text)).when(k % n == 4, "Infinity").when(k % n == 5, "n/a").otherwise(text)

    return raw.withColumns(
        {
            "order_date": date("order_date"),
            "ship_date": date("ship_date"),
            "sales": number("sales", 23),
            "quantity": number("quantity", 37),
            "discount": number("discount", 41),
            "profit": number("profit", 43),
        }
    )


def _malformed(raw: DataFrame) -> DataFrame:
    """The rows as a file with extra cells, missing cells and open quotes in some lines, read back."""
    spark, k = raw.sparkSession, F.col("order_id").cast("long") % 97
    text = F.to_csv(F.struct(*[raw[c] for c in raw.columns]), {"escape": '"'})
    line = (
        F.when(k == 5, F.concat(text, F.lit(",x,y")))
        .when(k == 6, F.regexp_replace(text, "(,[^,]*){3}$", ""))
        .when(k == 7, F.concat(F.lit('"'), text))
        .otherwise(text)
    )
    # Files of so many orders each begin with the header.
    files = raw.select(F.expr(f"cast(order_id as bigint) div {ORDERS}").alias("file"), line.alias("line"))
    whole = F.array_join(F.concat(F.array(F.lit(",".join(EXPECTED_COLUMNS))), F.collect_list("line")), "\n")
    path = staging_path(spark, "lines")
    files.groupBy("file").agg(whole.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    read = cleaning.rename_columns(read_raw(spark, path, unreadable="mark"))
    return quality.unreadable_cells(stage(read.select(UNREADABLE), "read"))


def _parsed(raw: DataFrame) -> DataFrame:
    return typed(_as_text(raw), unreadable="mark")


QUERIES = {
    "raw_parsed": _on_raw(lambda df: _parsed(df).withColumn("unreadable", F.array_join(UNREADABLE, ",")).drop(UNREADABLE)),
    "raw_unreadable": _on_raw(lambda df: quality.unreadable_cells(_parsed(df))),
    "raw_malformed": _on_raw(_malformed),
    "quality_report_cleaned": _on_raw(
        lambda df: quality.quality_report(stage(clean_sales(df), "cleaned"), "CLEANED", stored=True).drop("missing_per_col")
    ),
    "quality_report": _on_raw(lambda df: quality.quality_report(df, "RAW").drop("missing_per_col")),
    "quality_missing": _on_raw(
        lambda df: quality.missing_by_column(quality.quality_report(df, "RAW", duplicates=False))
    ),
    "clean_dedup": _on_raw(cleaning.drop_duplicates),
    "dup_order_ids": _on_raw(lambda df: cleaning.repeated_orders(cleaning.drop_duplicates(df))),
    "clean_impute_numeric": _on_unique(cleaning.impute_numeric),
    "clean_impute_categorical": _on_unique(cleaning.impute_categorical),
    "clean_drop_null_dates": _on_raw(cleaning.drop_null_dates),
    "clean_fill_text": _on_raw(cleaning.fill_text),
    "clean_standardise": _on_raw(cleaning.standardise),
    "clean_valid_sales": _on_raw(cleaning.drop_nonpositive_sales),
    "clean_numeric_rules": _on_raw(cleaning.numeric_rules),
    "clean_iqr_cap": _on_raw(_cap),
    "clean_valid_dates": _on_raw(cleaning.drop_inverted_dates),
    "clean_derived": _on_raw(cleaning.add_derived),
    "cleaned_sales": _on_raw(clean_sales),
    "quality_summary": _on_raw(lambda df: summarise(*clean_with_report(df))),
    "cleaning_audit": _on_raw(quality.cleaning_audit),
}
