"""The exploratory tables as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.written import cleaned
from tillroll.operators import eda



def _on_cleaned(table, **params):
    return lambda spark, folder: table(cleaned(spark, folder), **params)


def _rounded(df, places, *columns):
    """Digits beyond ``places`` differ between engines' logarithms and variances."""
    return df.withColumns({c: F.round(c, places) for c in columns})


QUERIES = {
    "eda_sales_hist": _on_cleaned(eda.histogram, column="sales", bins=60),
    "eda_log_sales_hist": _on_cleaned(
        lambda df: _rounded(eda.histogram(df, "sales", 50, log=True), 9, "bin_start", "bin_end")
    ),
    "eda_monthly_trend": _on_cleaned(eda.monthly_trend),
    "eda_quarterly": _on_cleaned(eda.quarterly),
    "eda_quarter_pivot": _on_cleaned(eda.quarter_by_year),
    "eda_category_share": _on_cleaned(eda.category_share),
    "eda_top2_share": _on_cleaned(eda.top_share),
    "eda_subcat_region": _on_cleaned(eda.subcategory_by_region),
    "eda_regional": _on_cleaned(eda.regional),
    "eda_correlation": _on_cleaned(lambda df: _rounded(eda.correlation(df), 6, "corr")),
    "eda_discount_profit_bins": _on_cleaned(eda.discount_profit_bins),
    "eda_segment": _on_cleaned(eda.segments),
    "eda_overview": _on_cleaned(eda.overview),
    "eda_top_performers": _on_cleaned(eda.top_performers),
    "eda_discount_risk": _on_cleaned(eda.discount_risk),
    "eda_q4_peak_check": _on_cleaned(eda.q4_peak_check),
}
