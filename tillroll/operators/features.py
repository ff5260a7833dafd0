"""Monthly features by region and category, their split and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.dates import fill_months
from tillroll.functions.numeric import money_total
from tillroll.staging import stage

KEYS = ["year", "month", "quarter", "region", "category"]
SERIES = ["region", "category"]
LAGS = ["lag_1_sales", "lag_2_sales", "lag_3_sales"]
TARGET = "total_sales"

# The model inputs, in order.
FEATURES = [
    "month", "quarter", "year", "region_enc", "category_enc", "avg_discount", "order_count",
    "avg_quantity", "lag_1_sales", "lag_2_sales", "lag_3_sales", "rolling_3avg", "is_q4",
    "is_holiday",
]


def monthly_features(cleaned: DataFrame) -> DataFrame:
    return (
        cleaned.dropna("any", subset=KEYS)
        .groupBy(*KEYS)
        .agg(
            money_total(F.col("sales")).alias(TARGET),
            F.avg("discount").alias("avg_discount"),
            F.count_distinct("order_id").alias("order_count"),
            F.avg("quantity").alias("avg_quantity"),
            F.avg("profit_margin_pct").alias("avg_profit_margin"),
        )
    )


def add_months(monthly: DataFrame) -> DataFrame:
    """The months without sales between the first and last one of a series: no orders, no averages."""
    dated = monthly.withColumn("_month", F.make_date("year", "month", F.lit(1)))
    at = F.col("_month")
    return (
        fill_months(dated, "_month", SERIES, [TARGET, "order_count"])
        .withColumns({"year": F.year(at), "month": F.month(at), "quarter": F.quarter(at)})
        .drop("_month")
    )


def add_lags(monthly: DataFrame, densify: bool = False) -> DataFrame:
    """Sales one, two and three rows back in the series and their mean.

    The mean needs all three rows, so it is null wherever a lag is. ``densify`` adds the months
    without sales first, so that the rows back are months back.
    """
    if densify:
        monthly = add_months(monthly)
    series = Window.partitionBy(*SERIES).orderBy("year", "month")
    lagged = monthly.withColumns(
        {name: F.lag(TARGET, k).over(series) for k, name in enumerate(LAGS, start=1)}
    )
    return lagged.withColumn("rolling_3avg", sum(F.col(c) for c in LAGS) / 3)


def add_seasons(monthly: DataFrame) -> DataFrame:
    return monthly.withColumns(
        {
            "is_q4": (F.col("quarter") == 4).cast("int"),
            "is_holiday": F.col("month").isin(11, 12).cast("int"),
        }
    )


def labels(df: DataFrame, column: str) -> DataFrame:
    """Each distinct value with its 0-based position in alphabetical order."""
    position = F.dense_rank().over(Window.orderBy(column)) - 1
    return df.select(column).distinct().withColumn(f"{column}_enc", position)


def encode(df: DataFrame, columns: list[str] = SERIES) -> DataFrame:
    for c in columns:
        df = df.join(labels(df, c), c)
    return df


def feature_matrix(cleaned: DataFrame, densify: bool = False) -> DataFrame:
    """All features; rows without a full history are dropped before the labels are numbered.

    With ``densify`` months without sales count in the histories, as zero; they get no rows of their own.

    The history is staged (a row per month, region and category), so numbering
    the labels does not aggregate the sales again.
    """
    history = add_seasons(add_lags(monthly_features(cleaned), densify)).dropna("any")
    history = stage(history.hint("rebalance"), "history")
    matrix = encode(history)
    return matrix.select(*history.columns, *[f"{c}_enc" for c in SERIES])


def split_bucket(buckets: int = 5) -> Column:
    """A bucket number that depends on the row's keys alone, not on partitioning."""
    month = F.col("year") * 12 + F.col("month")
    return (month + 7 * F.col("region_enc") + 3 * F.col("category_enc")) % buckets


def fold_number(folds: int = 5) -> Column:
    return ((F.col("year") * 12 + F.col("month") + F.col("region_enc")) % folds).cast("int")


def split(matrix: DataFrame) -> DataFrame:
    """The matrix with ``is_test``: one bucket in five is held out."""
    return matrix.withColumn("is_test", split_bucket() == 0)


def scale(matrix: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Standard scores ``<column>_sc`` by mean and population deviation of the training rows.

    A column that does not vary becomes 0.
    """
    train = matrix.where("not is_test")
    moments = train.agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns]
    )
    fitted = matrix.withColumn("_moments", moments.select(F.struct(*columns)).scalar())

    def score(c: str) -> Column:
        m = F.col("_moments")[c]
        return (F.col(c) - m["mean"]) / F.coalesce(F.nullif(m["sd"], F.lit(0.0)), F.lit(1.0))

    return fitted.withColumns({f"{c}_sc": score(c) for c in columns}).drop("_moments")
