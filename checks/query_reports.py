"""The business reports as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import reports, rollup, sketches
from tillroll.operators.distinct import count_bitmaps, distinct_bitmaps
from tillroll.sources.layout import sales_of_layout, write_layout
from tillroll.sources.star import sales_table
from tillroll.staging import stage, staging_path

# The test orders run from 1995 to the middle of 2001.
CURRENT, PRIOR = 2000, 1999


def _on_sales(report, **params):
    return lambda spark, folder: report(sales_table(spark, folder), **params)


def _with_gaps(spark, folder):
    """The sales without some months, every seventh of the calendar."""
    month = F.year("order_date") * 12 + F.month("order_date")
    return sales_table(spark, folder).where(month % 7 != 3)


def _distinct_by_region(spark, folder):
    """Orders and customers of each region and overall, from one stored table of bitmaps by year and region."""
    sales = sales_table(spark, folder).withColumn("yr", F.year("order_date"))
    stored = stage(distinct_bitmaps(sales, ["yr", "region"], ["order_id", "customer_id"]), "bitmaps")
    overall = count_bitmaps(stored, []).withColumn("region", F.lit("all"))
    return count_bitmaps(stored, ["region"]).unionByName(overall)


def _from_rollup(report, **params):
    """The report on a rollup that is written first, with the bitmaps if it takes them."""

    def query(spark, folder):
        path = staging_path(spark, "rollup")
        rollup.write_rollup(sales_table(spark, folder), path)
        days, ids = rollup.read_rollup(spark, path)
        return report(days, ids) if report is rollup.kpi_cards else report(days, **params)

    return query


def _sketched(spark, folder):
    """By region, exact figures and whether estimates merged from sketches by month keep to their bounds."""
    sales = sales_table(spark, folder).withColumn("month", F.trunc("order_date", "month"))
    stored = stage(sketches.sketch(sales, ["month", "region"], ["order_id", "customer_id"], ["sales"]), "sketches")
    found = sketches.estimates(stored, ["region"], (0.25, 0.5, 0.9)).withColumnRenamed("region", "_region")
    lines = sales.join(F.broadcast(found), F.col("region").eqNullSafe(F.col("_region")))  # a row per region
    figures = {"orders": "order_id", "customers": "customer_id"}
    shares = {q: F.avg((F.col("sales") <= F.col("quantiles_sales")[i]).cast("int")) for i, q in enumerate((0.25, 0.5, 0.9))}
    exact = lines.groupBy("region").agg(
        *[F.count_distinct(c).alias(n) for n, c in figures.items()],
        *[F.first(f"distinct_{c}").alias(f"_{n}") for n, c in figures.items()],
        *[x.alias(f"_{q}") for q, x in shares.items()],
    )
    close = [F.abs(F.col(f"_{n}") / F.col(n) - 1) <= 1.5 * sketches.distinct_error() for n in figures]
    near = [F.abs(F.col(f"`_{q}`") - q) <= 2 * sketches.rank_error() for q in shares]
    kept = {"counts_kept": close, "quantiles_kept": near}
    return exact.select("region", *figures, *[F.array_min(F.array(*x)).alias(n) for n, x in kept.items()])


def _bucketed(spark, folder):
    path = staging_path(spark, "layout")
    prefix = path.rsplit("/", 1)[-1].replace("-", "_")
    write_layout(spark, folder, path, buckets=8, prefix=prefix)
    return sales_of_layout(spark, prefix)


QUERIES = {
    "sales_view": sales_table,
    "sales_view_bucketed": _bucketed,
    "sketched_estimates": _sketched,
    "kpi_cards_rollup": _from_rollup(rollup.kpi_cards),
    "kpi_drill_rollup": _from_rollup(rollup.drill_through),
    "monthly_year_compare_rollup": _from_rollup(rollup.monthly_year_compare, current=CURRENT, prior=PRIOR),
    "kpi_overall": _on_sales(reports.kpi_overall),
    "monthly_mom_growth": _on_sales(reports.monthly_growth),
    "monthly_neighbours": _on_sales(reports.monthly_growth, following=True),
    "monthly_growth_of_calendar": lambda spark, folder: reports.monthly_growth(_with_gaps(spark, folder), densify=True),
    "region_performance": _on_sales(reports.region_performance),
    "distinct_from_bitmaps": _distinct_by_region,
    "top_states": _on_sales(reports.top_states),
    "category_contribution": _on_sales(reports.category_contribution),
    "top_subcategories": _on_sales(reports.top_subcategories),
    "segment_analysis": _on_sales(reports.segment_analysis),
    "category_yoy": _on_sales(reports.category_yoy, current=CURRENT, prior=PRIOR),
    "quarterly_seasonality": _on_sales(reports.quarterly_seasonality),
    "shipping_profitability": _on_sales(reports.shipping_profitability),
    "discount_buckets": _on_sales(reports.discount_buckets),
    "customer_ltv": _on_sales(reports.customer_ltv),
    "customer_value_ranks": _on_sales(reports.customer_value_ranks),
}
