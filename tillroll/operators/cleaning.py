"""Cleaning steps: each takes the order lines and returns them changed.

Steps that need column statistics compute them first, as distributed
aggregates. Only the finished numbers (one per column) come back, and enter the
plan as literals: no step joins the table with anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.numeric import clip, half_even, ratio
from tillroll.functions.text import strip, title_case
from tillroll.operators.statistics import modes, quantiles
from tillroll.schema import CATEGORICAL, DATES, NUMERIC, RENAMES, TEXT, UNREADABLE


def rename_columns(df: DataFrame) -> DataFrame:
    """Header names to canonical names; absent ones are skipped."""
    return df.withColumnsRenamed(RENAMES)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of every set of fully equal rows; copies are dropped before the shuffle."""
    return df.dropDuplicates()


def repeated_orders(df: DataFrame) -> DataFrame:
    """How many order ids occur more than once (they are kept: orders have several lines)."""
    return (
        df.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .count()
        .where("count > 1")
        .agg(F.count(F.lit(1)).alias("repeated_order_ids"))
    )


def impute_numeric(
    df: DataFrame, columns: list[str] = NUMERIC, accuracy: int | None = None
) -> DataFrame:
    """Fill nulls with the column's median; cells marked as unreadable stay null."""
    medians = quantiles(df, {c: [0.5] for c in columns}, accuracy)
    return _fill(df, {c: v for (c, _), v in medians.items()})


def impute_categorical(df: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """Fill nulls with the column's most frequent value."""
    return _fill(df, modes(df, columns))


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill nulls; a column without any value has none to fill with and stays null."""
    return df.withColumns(
        {c: F.when(absent(df, c), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}
    )


def absent(df: DataFrame, c: str) -> Column:
    """Nothing stood in the cell; it was not an unreadable one."""
    if UNREADABLE not in df.columns:
        return F.col(c).isNull()
    return F.col(c).isNull() & ~F.array_contains(UNREADABLE, c)


def drop_null_dates(df: DataFrame, columns: list[str] = DATES) -> DataFrame:
    return df.dropna("any", subset=columns)


def fill_text(df: DataFrame, columns: list[str] = TEXT, value: str = "Unknown") -> DataFrame:
    return df.fillna(dict.fromkeys(columns, value))


def standardise(
    df: DataFrame,
    columns: list[str] | None = None,
    value_maps: dict[str, dict[str, str]] | None = None,
) -> DataFrame:
    """Strip and title-case the string columns (all by default), then map known values, if any are given.

    Nulls stay null.
    """
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: title_case(strip(F.col(c))) for c in columns})
    mapped = {c: m for c, m in (value_maps or {}).items() if c in df.columns}
    return df.withColumns({c: _mapped(F.col(c), m) for c, m in mapped.items()})


def _mapped(x: Column, known: dict[str, str]) -> Column:
    """The value the map gives for x, or x itself."""
    table = F.create_map(*[F.lit(v) for pair in known.items() for v in pair])
    return F.coalesce(F.try_element_at(table, x), x)


def drop_nonpositive_sales(df: DataFrame) -> DataFrame:
    """Drop rows with sales <= 0; unknown sales are kept."""
    return df.where(~F.coalesce(F.col("sales") <= 0, F.lit(False)))


def numeric_rules(df: DataFrame) -> DataFrame:
    """Quantity: at least 1, rounded half to even, whole. Discount: within [0, 1]."""
    return df.withColumns(
        {
            "quantity": half_even(clip(F.col("quantity"), lower=1.0)).cast("bigint"),
            "discount": clip(F.col("discount"), lower=0.0, upper=1.0),
        }
    )


def sales_bounds(
    df: DataFrame, k: float = 3.0, accuracy: int | None = None
) -> tuple[float | None, float | None]:
    """The first quartile less, and the third plus, k interquartile ranges of sales."""
    quartiles = quantiles(df, {"sales": [0.25, 0.75]}, accuracy)
    if not quartiles:
        return None, None
    q1, q3 = quartiles["sales", 0.25], quartiles["sales", 0.75]
    return q1 - (q3 - q1) * k, q3 + (q3 - q1) * k


def cap_outliers(df: DataFrame, k: float = 3.0, accuracy: int | None = None) -> DataFrame:
    """Bring sales outside the bounds to the nearer bound."""
    lower, upper = sales_bounds(df, k, accuracy)
    return df.withColumn("sales", clip(F.col("sales"), lower, upper))


def drop_inverted_dates(df: DataFrame) -> DataFrame:
    """Drop rows shipped before they were ordered; the same day is fine, unknown is kept."""
    return df.where(~F.coalesce(F.col("ship_date") < F.col("order_date"), F.lit(False)))


def add_derived(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "year": F.year("order_date"),
            "month": F.month("order_date"),
            "quarter": F.quarter("order_date"),
            "day_of_week": F.date_format("order_date", "EEEE"),
            "days_to_ship": F.datediff("ship_date", "order_date"),
            "profit_margin_pct": ratio(F.col("profit"), F.col("sales")) * 100,
            "revenue_per_unit": ratio(F.col("sales"), F.col("quantity")),
        }
    )
