"""All exploratory tables over one cleaned table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillroll.operators import eda


def run_eda(
    cleaned: DataFrame, years: list[int] | None = None, regions: list[str] | None = None
) -> dict[str, DataFrame]:
    """The tables by name; each is computed when it is read."""
    return {
        "sales_distribution": eda.histogram(cleaned, "sales", 60),
        "log_sales_distribution": eda.histogram(cleaned, "sales", 50, log=True),
        "monthly_trend": eda.monthly_trend(cleaned),
        "quarterly": eda.quarterly(cleaned),
        "quarter_by_year": eda.quarter_by_year(cleaned, years),
        "category_share": eda.category_share(cleaned),
        "top_share": eda.top_share(cleaned),
        "subcategory_by_region": eda.subcategory_by_region(cleaned, regions),
        "regional": eda.regional(cleaned),
        "correlation": eda.correlation(cleaned),
        "discount_profit": eda.discount_profit_bins(cleaned),
        "segments": eda.segments(cleaned),
        "overview": eda.overview(cleaned),
        "top_performers": eda.top_performers(cleaned),
        "discount_risk": eda.discount_risk(cleaned),
        "q4_peak": eda.q4_peak_check(cleaned),
    }
