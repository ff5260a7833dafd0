"""The exploratory tables over cleaned sales (one per figure or summary line).

Rows without a group key are left out, as are missing values; an empty sum is 0.
Every table is aggregated where the data is and has a bounded number of rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.dates import month_name, month_start
from tillroll.functions.numeric import half_even, half_up, money_total, pct, ratio
from tillroll.staging import stage

NUMBERS = [
    "sales", "quantity", "discount", "profit", "profit_margin_pct", "days_to_ship",
    "revenue_per_unit",
]


def _grouped(df: DataFrame, *keys: str):
    return df.dropna("any", subset=list(keys)).groupBy(*keys)


def _limits(df: DataFrame, x: str) -> Column:
    """Scalar (lo, width-ready hi) of a column; equal ends are moved half a unit apart."""
    lo, hi = F.min(x), F.max(x)
    spread = F.when(lo == hi, 0.5).otherwise(0.0)
    return df.agg((lo - spread).alias("lo"), (hi + spread).alias("hi")).select(
        F.struct("lo", "hi")
    ).scalar()


def _bin(x: Column, limits: Column, bins: int) -> Column:
    """Equal-width bin number; the last bin includes the highest value."""
    width = (limits["hi"] - limits["lo"]) / bins
    return F.least(F.floor((x - limits["lo"]) / width), F.lit(bins - 1)).cast("int")


def _edge(number: Column, limits: Column, bins: int) -> Column:
    return limits["lo"] + number * ((limits["hi"] - limits["lo"]) / bins)


def histogram(df: DataFrame, column: str, bins: int, log: bool = False) -> DataFrame:
    """(bin, bin_start, bin_end, count), empty bins included; ``log`` bins log(1 + x)."""
    x = F.col(column).cast("double")
    values = df.select((F.log1p(x) if log else x).alias("x")).where("x is not null and not isnan(x)")
    limits = _limits(values, "x")
    counts = values.groupBy(_bin(F.col("x"), limits, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    numbers = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        numbers.join(counts, "bin", "left")
        .withColumn("_limits", limits)
        .select(
            "bin",
            _edge(F.col("bin"), F.col("_limits"), bins).alias("bin_start"),
            _edge(F.col("bin") + 1, F.col("_limits"), bins).alias("bin_end"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
        .orderBy("bin")
    )


def monthly_trend(df: DataFrame) -> DataFrame:
    return (
        _grouped(df, "year", "month")
        .agg(money_total(F.col("sales")).alias("sales"))
        .withColumn("period", month_start(F.col("year"), F.col("month")))
        .withColumn("in_q4", F.col("month") >= 10)
        .orderBy("year", "month")
    )


def quarterly(df: DataFrame) -> DataFrame:
    return (
        _grouped(df, "year", "quarter")
        .agg(money_total(F.col("sales")).alias("sales"), money_total(F.col("profit")).alias("profit"))
        .withColumn("label", F.format_string("Q%d %d", "quarter", "year"))
        .orderBy("year", "quarter")
    )


def _values(table: DataFrame, column: str) -> list:
    """The different values of a column of an already small, written table, in order."""
    return [r[0] for r in table.select(column).distinct().orderBy(column).collect()]


def quarter_by_year(df: DataFrame, years: list[int] | None = None) -> DataFrame:
    """One row per quarter, one column ``sales_<year>`` per year; null where there are no rows.

    Without a list every year present has a column; to find them the aggregate (one row per
    quarter and year) is computed and written when this is called.
    """
    table = quarterly(df)
    if years is None:
        table = stage(table, "quarters")
        years = _values(table, "year")
    return (
        table
        .groupBy("quarter")
        .pivot("year", years)
        .agg(F.first("sales"))
        .withColumnsRenamed({str(y): f"sales_{y}" for y in years})
        .orderBy("quarter")
    )


def category_share(df: DataFrame) -> DataFrame:
    by_category = _grouped(df, "category").agg(money_total(F.col("sales")).alias("sales"))
    share = ratio(F.col("sales"), F.sum("sales").over(Window.partitionBy())) * 100
    return by_category.withColumn("pct", half_even(share, 1)).orderBy(F.desc("sales"), "category")


def top_share(df: DataFrame, k: int = 2) -> DataFrame:
    """The rounded shares of the k largest categories, added up."""
    top = category_share(df).limit(k)
    return top.agg(half_even(F.sum("pct"), 1).alias("top_pct"))


def subcategory_by_region(df: DataFrame, regions: list[str] | None = None) -> DataFrame:
    """Sales of each sub-category by region, also in thousands, largest total first.

    Without a list every region present has a column; to find them the aggregate (one row per
    sub-category and region) is computed and written when this is called. With a list the
    other regions are summed in ``other``; the total is over all regions either way.
    """
    cells = _grouped(df, "sub_category", "region").agg(money_total(F.col("sales")).alias("sales"))
    listed = regions is not None
    if not listed:
        cells = stage(cells, "cells")
        regions = _values(cells, "region")
    names = {r: r.lower().replace(" ", "_") for r in regions}

    def summed(condition) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("sales"))), F.lit(0.0))

    columns = {n: summed(F.col("region") == r) for r, n in names.items()}
    if listed:
        columns["other"] = summed(~F.col("region").isin(regions))
    table = cells.groupBy("sub_category").agg(
        *[c.alias(n) for n, c in columns.items()], F.lit(None).cast("int").alias("_")
    )
    total = sum((F.col(n) for n in columns), F.lit(0.0))
    return table.select(
        "sub_category",
        *columns,
        *[half_even(F.col(n) / 1000).alias(f"{n}_k") for n in names.values()],
        total.alias("total"),
    ).orderBy(F.desc("total"), "sub_category")


def regional(df: DataFrame) -> DataFrame:
    return (
        _grouped(df, "region")
        .agg(
            money_total(F.col("sales")).alias("sales"),
            money_total(F.col("profit")).alias("profit"),
            F.count_distinct("order_id").alias("orders"),
        )
        .withColumn("profit_margin", half_even(ratio(F.col("profit"), F.col("sales")) * 100, 1))
        .orderBy("region")
    )


def correlation(df: DataFrame, columns: list[str] = NUMBERS) -> DataFrame:
    """(x, y, corr) below the diagonal; each pair over the rows that have both values.

    A constant column has no correlation (null). Rows are unpivoted into pairs
    inside the map stage, so one small aggregate serves every pair.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    pairs = ", ".join(f"(`{x}`, `{y}`) as `{x}|{y}`" for y, x in combinations(columns, 2))
    long = df.sparkSession.sql(
        f"select * from {{numbers}} unpivot include nulls ((a, b) for pair in ({pairs}))",
        numbers=numbers,
    )
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    return (
        long.where("a is not null and b is not null")
        .groupBy("pair")
        .agg(F.try_divide(F.covar_pop("a", "b"), spread).alias("corr"))
        .select(
            F.substring_index("pair", "|", 1).alias("x"),
            F.substring_index("pair", "|", -1).alias("y"),
            "corr",
        )
    )


def discount_profit_bins(
    df: DataFrame, discount_bins: int = 20, profit_bins: int = 40
) -> DataFrame:
    """The discount/profit cloud as a grid: lines and average sales of each cell in use."""
    points = df.select("discount", "profit", "sales").dropna("any", subset=["discount", "profit"])
    discounts, profits = _limits(points, "discount"), _limits(points, "profit")
    cells = points.groupBy(
        _bin(F.col("discount"), discounts, discount_bins).alias("discount_bin"),
        _bin(F.col("profit"), profits, profit_bins).alias("profit_bin"),
    ).agg(
        F.count(F.lit(1)).alias("lines"),
        half_up(ratio(money_total(F.col("sales")), F.count("sales"))).alias("avg_sales"),
    )
    return (
        cells.withColumns({"_d": discounts, "_p": profits})
        .select(
            "discount_bin",
            "profit_bin",
            _edge(F.col("discount_bin"), F.col("_d"), discount_bins).alias("discount_start"),
            _edge(F.col("profit_bin"), F.col("_p"), profit_bins).alias("profit_start"),
            "lines",
            "avg_sales",
        )
        .orderBy("discount_bin", "profit_bin")
    )


def segments(df: DataFrame) -> DataFrame:
    """``avg_order`` is the average per distinct order."""
    return (
        _grouped(df, "segment")
        .agg(
            money_total(F.col("sales")).alias("sales"),
            money_total(F.col("profit")).alias("profit"),
            F.count_distinct("customer_id").alias("customers"),
            F.count_distinct("order_id").alias("orders"),
        )
        .withColumn("avg_order", ratio(F.col("sales"), F.col("orders")))
        .orderBy("segment")
    )


def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("order_id").alias("orders"),
        F.count_distinct("customer_id").alias("customers"),
        F.min("order_date").alias("first_date"),
        F.max("order_date").alias("last_date"),
        money_total(F.col("sales")).alias("revenue"),
        money_total(F.col("profit")).alias("profit"),
        pct(money_total(F.col("profit")), money_total(F.col("sales")), 1).alias("margin_pct"),
    )


def top_performers(df: DataFrame) -> DataFrame:
    """One row: the region, category and month with the highest sales, the first on ties.

    Grouping sets sum all three breakdowns and the grand total in one pass.
    """
    keys = ["region", "category", "month"]
    sums = (
        df.select(*keys, "sales")
        .groupingSets([[c] for c in keys] + [[]], *keys)
        .agg(money_total(F.col("sales")).alias("sales"), F.grouping_id().alias("_set"))
    )
    # grouping_id has a bit set for every key that is summed over.
    sets = {"region": 0b011, "category": 0b101, "month": 0b110}

    def best(key: str) -> Column:
        in_set = (F.col("_set") == sets[key]) & F.col(key).isNotNull()
        return F.min(F.when(in_set, F.struct((-F.col("sales")).alias("_s"), F.col(key).alias("key"))))

    total = F.max(F.when(F.col("_set") == 0b111, F.col("sales")))
    picked = sums.agg(*[best(c).alias(c) for c in keys], total.alias("_total"))
    return picked.select(
        F.col("region.key").alias("top_region"),
        F.col("category.key").alias("top_category"),
        half_up(ratio(-F.col("category._s"), F.col("_total")) * 100, 1).alias("top_category_pct"),
        F.col("month.key").alias("peak_month"),
        month_name(F.col("month.key")).alias("peak_month_name"),
    )


def discount_risk(df: DataFrame, high: float = 0.3, low: float = 0.1) -> DataFrame:
    """Average profit of lines discounted above ``high`` and of those up to ``low``."""

    def avg_profit(condition: Column) -> Column:
        profit = F.when(condition, F.col("profit"))
        return half_up(ratio(money_total(profit), F.count(profit)))

    return df.agg(
        avg_profit(F.col("discount") > high).alias("avg_profit_high_discount"),
        avg_profit(F.col("discount") <= low).alias("avg_profit_low_discount"),
    )


def q4_peak_check(df: DataFrame) -> DataFrame:
    """(year, peak_quarter, q4_is_peak): whether the fourth quarter sold most, year by year."""
    best = F.min(F.struct((-F.col("sales")).alias("_s"), F.col("quarter").alias("quarter")))
    return (
        quarterly(df)
        .groupBy("year")
        .agg(best.alias("_best"))
        .select(
            "year",
            F.col("_best.quarter").alias("peak_quarter"),
            (F.col("_best.quarter") == 4).alias("q4_is_peak"),
        )
        .orderBy("year")
    )
