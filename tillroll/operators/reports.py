"""The business reports over the flat sales table.

Money is decimal, so sums are exact; every ratio is null when its denominator is
zero. Distinct counts are exact unless ``rsd`` asks for a sketch of that relative
error. Sorts end in the group keys, so results do not depend on chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.dates import fill_months, in_years
from tillroll.functions.numeric import distinct_count, half_up, mean, pct, ratio
from tillroll.operators.ranking import ntile_of, rank_all, top_ranked
from tillroll.staging import stage


def _total(x: str) -> Column:
    return half_up(F.sum(x))


def _margin() -> Column:
    return pct(F.sum("profit"), F.sum("sales"))


def kpi_overall(sales: DataFrame, rsd: float | None = None) -> DataFrame:
    return sales.agg(
        distinct_count("order_id", rsd).alias("total_orders"),
        distinct_count("customer_id", rsd).alias("total_customers"),
        _total("sales").alias("total_revenue"),
        _total("profit").alias("total_profit"),
        F.sum("quantity").alias("total_units_sold"),
        _margin().alias("profit_margin_pct"),
    )


def monthly_growth(sales: DataFrame, following: bool = False, densify: bool = False) -> DataFrame:
    """Sales by month and the change from the month before it in the table.

    ``following`` adds the sales of the month after it. ``densify`` gives months without sales a
    row of zeros, so that the month before is the one of the calendar.
    """
    monthly = sales.groupBy(
        F.year("order_date").alias("yr"),
        F.month("order_date").alias("mth"),
        F.date_format("order_date", "yyyy-MM").alias("yr_month"),
    ).agg(_total("sales").alias("monthly_sales"), _total("profit").alias("monthly_profit"))
    if densify:
        dated = monthly.withColumn("_month", F.make_date("yr", "mth", F.lit(1)))
        at = F.col("_month")
        filled = fill_months(dated, "_month", [], ["monthly_sales", "monthly_profit"])
        monthly = filled.withColumns({"yr": F.year(at), "mth": F.month(at), "yr_month": F.date_format(at, "yyyy-MM")}).drop("_month")
    by_month = Window.orderBy(F.asc_nulls_first("yr"), F.asc_nulls_first("mth"))
    previous = F.col("prev_month_sales")
    if following:
        monthly = monthly.withColumn("next_month_sales", F.lead("monthly_sales").over(by_month))
    return (
        monthly.withColumn("prev_month_sales", F.lag("monthly_sales").over(by_month))
        .withColumn("mom_growth_pct", pct(F.col("monthly_sales") - previous, previous))
        .orderBy(F.asc_nulls_first("yr"), F.asc_nulls_first("mth"))
    )


def region_performance(sales: DataFrame, rsd: float | None = None) -> DataFrame:
    grouped = sales.groupBy("region").agg(
        F.sum("sales").alias("_sales"),
        _total("sales").alias("total_sales"),
        _total("profit").alias("total_profit"),
        _margin().alias("profit_margin_pct"),
        distinct_count("customer_id", rsd).alias("unique_customers"),
    )
    by_sales = Window.orderBy(F.desc_nulls_last("_sales"))
    return (
        grouped.withColumn("revenue_rank", F.rank().over(by_sales).cast("bigint"))
        .orderBy(F.desc_nulls_last("_sales"), F.asc_nulls_last("region"))
        .drop("_sales")
    )


def top_states(sales: DataFrame, k: int = 10, rsd: float | None = None) -> DataFrame:
    grouped = sales.groupBy("state", "region").agg(
        F.sum("sales").alias("_sales"),
        _total("sales").alias("total_sales"),
        _total("profit").alias("total_profit"),
        distinct_count("order_id", rsd).alias("order_count"),
    )
    return top_ranked(grouped, "_sales", ["state", "region"], k, "state_rank").drop("_sales")


def category_contribution(sales: DataFrame) -> DataFrame:
    """Each category's share of all sales; the grand total is summed over the categories."""
    grouped = sales.groupBy("category").agg(
        F.sum("sales").alias("_sales"), F.sum("profit").alias("_profit")
    )
    everything = F.sum("_sales").over(Window.partitionBy())
    return grouped.select(
        "category",
        half_up(F.col("_sales")).alias("category_sales"),
        pct(F.col("_sales"), everything).alias("revenue_contribution_pct"),
        half_up(F.col("_profit")).alias("category_profit"),
        pct(F.col("_profit"), F.col("_sales")).alias("profit_margin_pct"),
    ).orderBy(F.desc_nulls_last("category_sales"), F.asc_nulls_last("category"))


def top_subcategories(sales: DataFrame, k: int = 10) -> DataFrame:
    grouped = sales.groupBy("sub_category", "category").agg(
        F.sum("sales").alias("_sales"),
        _total("sales").alias("total_sales"),
        _total("profit").alias("total_profit"),
        F.sum("quantity").alias("units_sold"),
        half_up(ratio(F.sum("discount"), F.count("discount")) * 100).alias("avg_discount_pct"),
    )
    keys = ["sub_category", "category"]
    return top_ranked(grouped, "_sales", keys, k, "sales_rank").drop("_sales")


def segment_analysis(sales: DataFrame, rsd: float | None = None) -> DataFrame:
    """``avg_order_value`` is the average per order line."""
    return (
        sales.groupBy("segment")
        .agg(
            distinct_count("customer_id", rsd).alias("customer_count"),
            distinct_count("order_id", rsd).alias("order_count"),
            _total("sales").alias("total_sales"),
            mean(F.col("sales")).alias("avg_order_value"),
            _margin().alias("profit_margin_pct"),
        )
        .orderBy(F.desc_nulls_last("total_sales"), F.asc_nulls_last("segment"))
    )


CUSTOMER = ["customer_id", "customer_name", "segment", "region"]


def customer_metrics(sales: DataFrame, rsd: float | None = None) -> DataFrame:
    return sales.groupBy(*CUSTOMER).agg(
        distinct_count("order_id", rsd).alias("total_orders"),
        _total("sales").alias("lifetime_value"),
        mean(F.col("sales")).alias("avg_order_value"),
        F.min("order_date").alias("first_purchase"),
        F.max("order_date").alias("last_purchase"),
        F.datediff(F.max("order_date"), F.min("order_date")).alias("customer_tenure_days"),
    )


def customer_value_ranks(sales: DataFrame, buckets: int = 4) -> DataFrame:
    """Every customer with the quartile and rank of their lifetime value."""
    metrics = customer_metrics(sales)
    return rank_all(metrics, "lifetime_value", CUSTOMER, buckets, "value_rank", "value_quartile")


def customer_ltv(sales: DataFrame, k: int = 20, buckets: int = 4) -> DataFrame:
    """The k most valuable customers, with their quartile and rank among all customers.

    The quartile follows from the row number and the number of customers, so the
    customers need no global window.
    """
    metrics = stage(customer_metrics(sales), "customers")
    customers = metrics.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = top_ranked(metrics, "lifetime_value", CUSTOMER, k, "value_rank")
    order = [F.desc_nulls_last("lifetime_value"), *[F.asc_nulls_last(c) for c in CUSTOMER]]
    row = F.row_number().over(Window.orderBy(*order))
    return (
        top.withColumns({"_row": row, "_customers": customers})
        .withColumn("value_quartile", ntile_of(F.col("_row"), F.col("_customers"), buckets))
        .orderBy("_row")
        .select(*metrics.columns, "value_quartile", "value_rank")
    )


def category_yoy(sales: DataFrame, current: int, prior: int) -> DataFrame:
    """Sales of two years side by side, for the categories sold in both; one pass over the table."""
    in_current = in_years(F.col("order_date"), current)
    in_prior = in_years(F.col("order_date"), prior)
    grouped = (
        sales.where(in_current | in_prior)
        .where(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            half_up(F.sum(F.when(in_current, F.col("sales")))).alias("sales_current"),
            half_up(F.sum(F.when(in_prior, F.col("sales")))).alias("sales_prior"),
            F.count_if(in_current).alias("_current"),
            F.count_if(in_prior).alias("_prior"),
        )
        .where("_current > 0 and _prior > 0")
    )
    change = F.col("sales_current") - F.col("sales_prior")
    return grouped.select(
        "category",
        "sales_current",
        "sales_prior",
        half_up(change).alias("yoy_change"),
        pct(change, F.col("sales_prior")).alias("yoy_growth_pct"),
    ).orderBy(F.desc_nulls_last("yoy_change"), "category")


def quarterly_seasonality(sales: DataFrame, rsd: float | None = None) -> DataFrame:
    return (
        sales.groupBy(
            F.quarter("order_date").alias("quarter"), F.year("order_date").alias("year")
        )
        .agg(
            _total("sales").alias("quarterly_sales"),
            _total("profit").alias("quarterly_profit"),
            distinct_count("order_id", rsd).alias("order_count"),
            mean(F.col("sales")).alias("avg_order_value"),
        )
        .orderBy(F.asc_nulls_first("year"), F.asc_nulls_first("quarter"))
    )


def shipping_profitability(sales: DataFrame, rsd: float | None = None) -> DataFrame:
    days = F.datediff("ship_date", "order_date")
    return (
        sales.groupBy("ship_mode")
        .agg(
            distinct_count("order_id", rsd).alias("order_count"),
            _total("sales").alias("total_sales"),
            _total("profit").alias("total_profit"),
            _margin().alias("profit_margin_pct"),
            mean(days, 1).alias("avg_days_to_ship"),
        )
        .orderBy(F.desc_nulls_last("total_sales"), F.asc_nulls_last("ship_mode"))
    )


def discount_bucket(discount: Column) -> Column:
    """The first bucket that fits; below zero and null fall in the last one."""
    return (
        F.when(discount == 0, "No Discount")
        .when(discount.between(0, 0.1), "1-10%")
        .when(discount.between(0.1, 0.2), "11-20%")
        .when(discount.between(0.2, 0.3), "21-30%")
        .otherwise("30%+")
    )


def discount_buckets(sales: DataFrame) -> DataFrame:
    """``order_count`` counts order lines."""
    return (
        sales.groupBy(discount_bucket(F.col("discount")).alias("discount_bucket"))
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            mean(F.col("profit")).alias("avg_profit"),
            _total("profit").alias("total_profit"),
            mean(F.col("sales")).alias("avg_order_value"),
        )
        .orderBy(F.desc_nulls_last("avg_profit"), "discount_bucket")
    )
