"""The tables behind the dashboard: cards, drill-through, year comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.dates import in_years
from tillroll.functions.numeric import half_up, pct


def kpi_cards(sales: DataFrame) -> DataFrame:
    """(kpi, value): the overall figures, the latest month and its growth, sales by region.

    The table is read once, into sums by region and month, a row for each order and one for each
    customer; the whole, months and regions are summed and counted from those.
    """
    sums, ids = ["sales", "profit", "quantity"], {"total_orders": "order_id", "total_customers": "customer_id"}
    types = {f.name: f.dataType for f in sales.schema.fields}

    def row(of: str, **values: Column) -> Column:
        kinds = {"region": "string", "month": "string", "id": "string"} | {c: types[c] for c in sums}
        cells = [values.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
        return F.struct(F.lit(of).alias("of"), *cells)

    month = F.date_format("order_date", "yyyy-MM")
    each = [row("", region=F.col("region"), month=month, **{c: F.col(c) for c in sums})]
    each += [row(name, id=F.col(c)) for name, c in ids.items()]
    rows = sales.select(F.inline(F.array(*each)))
    found = rows.groupBy("of", "region", "month", "id").agg(*[F.sum(c).alias(c) for c in sums])
    return cards_of(card_sums(found, {name: F.count_if((F.col("of") == name) & F.col("id").isNotNull()) for name in ids}))


def card_sums(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """The figures of the whole, each region and each month, with ``counts`` beside the sums."""
    # grouping_id has a bit set for every key that is summed over.
    return rows.groupingSets([[], ["region"], ["month"]], "region", "month").agg(
        F.grouping_id().alias("_set"),
        *[x.alias(c) for c, x in counts.items()],
        half_up(F.sum("sales")).alias("total_revenue"),
        half_up(F.sum("profit")).alias("total_profit"),
        F.sum("quantity").alias("total_units_sold"),
        pct(F.sum("profit"), F.sum("sales")).alias("profit_margin_pct"),
    ).withColumn("value", F.col("total_revenue"))


def cards_of(sums: DataFrame) -> DataFrame:
    """(kpi, value) from the rows of ``card_sums``."""
    by_month = Window.partitionBy("_set").orderBy(F.asc_nulls_first("month"))
    latest = F.max("month").over(Window.partitionBy("_set"))
    cards = sums.withColumns({"_previous": F.lag("value").over(by_month), "_latest": latest})
    figures = [
        F.struct(F.lit(c).alias("kpi"), F.col(c).cast("double").alias("value"))
        for c in sums.columns if c.startswith("total_") or c == "profit_margin_pct"
    ]
    region = F.struct(F.concat(F.lit("region_sales: "), "region").alias("kpi"), "value")
    month = F.struct(F.lit("latest_month_sales").alias("kpi"), "value")
    growth = F.struct(
        F.lit("latest_mom_growth_pct").alias("kpi"),
        pct(F.col("value") - F.col("_previous"), F.col("_previous")).alias("value"),
    )
    parts = F.when(F.col("_set") == 0b11, F.array(*figures)).when(
        (F.col("_set") == 0b01) & F.col("region").isNotNull(), F.array(region)
    ).when((F.col("_set") == 0b10) & (F.col("month") == F.col("_latest")), F.array(month, growth))
    return cards.select(F.inline(parts))


DRILL = ["region", "category", "segment"]


def drill_through(sales: DataFrame, lines: str | None = None) -> DataFrame:
    """Totals overall and by region, category and segment, from one pass over the table.

    ``level`` says which breakdown a row belongs to. ``lines`` names a column that says how many
    lines each row stands for, if it isn't one.
    """
    # grouping_id has a bit set for every key that is summed over.
    levels = {0b111: "total", 0b011: "region", 0b101: "category", 0b110: "segment"}
    level = F.create_map(*[F.lit(x) for pair in levels.items() for x in pair])
    return (
        sales.select(*DRILL, "sales", "profit", "quantity", (F.col(lines) if lines else F.lit(1)).alias("_lines"))
        .groupingSets([[]] + [[c] for c in DRILL], *DRILL)
        .agg(
            level[F.grouping_id().cast("int")].alias("level"),
            F.coalesce(F.sum("_lines"), F.lit(0)).alias("lines"),
            half_up(F.sum("sales")).alias("total_sales"),
            half_up(F.sum("profit")).alias("total_profit"),
            F.sum("quantity").alias("units_sold"),
            pct(F.sum("profit"), F.sum("sales")).alias("profit_margin_pct"),
        )
    )


def monthly_year_compare(sales: DataFrame, current: int, prior: int) -> DataFrame:
    """Month by month, the sales of two years and their difference."""
    in_current = in_years(F.col("order_date"), current)
    in_prior = in_years(F.col("order_date"), prior)
    monthly = (
        sales.where(in_current | in_prior)
        .groupBy(F.month("order_date").alias("month"))
        .agg(
            half_up(F.sum(F.when(in_current, F.col("sales")))).alias("sales_current"),
            half_up(F.sum(F.when(in_prior, F.col("sales")))).alias("sales_prior"),
        )
    )
    change = F.col("sales_current") - F.col("sales_prior")
    return monthly.withColumns(
        {"change": half_up(change), "change_pct": pct(change, F.col("sales_prior"))}
    ).orderBy("month")
