"""Comparison SQL of the features, the baseline forecast and the dashboard tables."""

from __future__ import annotations

from checks.oracle_base import MARGIN, TOTAL_PROFIT, TOTAL_SALES, WITH_SALES, half_up, pct
from checks.oracle_cleaning import CLEANED_CTE
from checks.oracle_eda import SALES
from checks.oracle_reports import GROWTH, MONTHLY

MONTHLY_CTE = f"""{CLEANED_CTE}, monthly AS (
SELECT year, month, quarter, region, category, {SALES} AS total_sales,
       AVG(discount) AS avg_discount, COUNT(DISTINCT order_id) AS order_count,
       AVG(quantity) AS avg_quantity, AVG(profit_margin_pct) AS avg_profit_margin
FROM cleaned_sales WHERE region IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""

SERIES = "OVER (PARTITION BY region, category ORDER BY year, month)"
LAGS_CTE = f"""{MONTHLY_CTE}, lagged AS (SELECT *,
 LAG(total_sales, 1) {SERIES} AS lag_1_sales, LAG(total_sales, 2) {SERIES} AS lag_2_sales,
 LAG(total_sales, 3) {SERIES} AS lag_3_sales FROM monthly), features AS (
SELECT *, (lag_1_sales + lag_2_sales + lag_3_sales) / 3 AS rolling_3avg FROM lagged)"""
MATRIX_CTE = f"""{LAGS_CTE}, full_rows AS (SELECT *, CAST(quarter = 4 AS INTEGER) AS is_q4,
 CAST(month IN (11, 12) AS INTEGER) AS is_holiday FROM features
WHERE rolling_3avg IS NOT NULL AND avg_profit_margin IS NOT NULL AND avg_discount IS NOT NULL
  AND avg_quantity IS NOT NULL), matrix AS (SELECT *,
 CAST(DENSE_RANK() OVER (ORDER BY region) - 1 AS INTEGER) AS region_enc,
 CAST(DENSE_RANK() OVER (ORDER BY category) - 1 AS INTEGER) AS category_enc FROM full_rows),
split AS (SELECT *, (year * 12 + month + 7 * region_enc + 3 * category_enc) % 5 = 0 AS is_test
FROM matrix)"""

KEYS = ["year", "month", "quarter", "region", "category"]
# Averages of doubles differ in the last digits with the order of addition.
ROUNDED = {
    "avg_discount": 9, "avg_quantity": 9, "avg_profit_margin": 6, "rolling_3avg": 4,
}
MEASURES = ["total_sales", "avg_discount", "order_count", "avg_quantity", "avg_profit_margin"]
LAGS = ["lag_1_sales", "lag_2_sales", "lag_3_sales", "rolling_3avg"]
SEASONS = ["is_q4", "is_holiday"]
ENCODED = ["region_enc", "category_enc"]
FEATURES = [
    "month", "quarter", "year", "region_enc", "category_enc", "avg_discount", "order_count",
    "avg_quantity", "lag_1_sales", "lag_2_sales", "lag_3_sales", "rolling_3avg", "is_q4",
    "is_holiday",
]


def columns(*names: str) -> str:
    return ", ".join(f"ROUND({c}, {ROUNDED[c]}) AS {c}" if c in ROUNDED else c for c in names)


ERROR = "(total_sales - rolling_3avg)"
METRICS = f"""ROUND(1 - AVG({ERROR} * {ERROR}) / VAR_POP(total_sales), 9) AS r2,
 ROUND(AVG(ABS({ERROR})), 4) AS mae, ROUND(SQRT(AVG({ERROR} * {ERROR})), 4) AS rmse"""


def score(c: str) -> str:
    mean = f"(SELECT AVG({c}) FROM split WHERE NOT is_test)"
    sd = f"(SELECT STDDEV_POP({c}) FROM split WHERE NOT is_test)"
    return f"ROUND(({c} - {mean}) / COALESCE(NULLIF({sd}, 0), 1), 6) AS {c}_sc"


def year_sum(year: int) -> str:
    return half_up(f"SUM(CASE WHEN YEAR(order_date) = {year} THEN sales END)")


def level(name: str, *keys: str) -> str:
    shown = ", ".join(c if c in keys else f"NULL AS {c}" for c in ("region", "category", "segment"))
    by = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {shown}, '{name}' AS level, COUNT(*) AS lines, {TOTAL_SALES} AS total_sales,
 {TOTAL_PROFIT} AS total_profit, CAST(SUM(quantity) AS BIGINT) AS units_sold,
 {MARGIN} AS profit_margin_pct FROM sales {by}"""


ORACLES = {
    "feature_monthly": f"{MONTHLY_CTE} SELECT {columns(*KEYS, *MEASURES)} FROM monthly",
    "feature_lags": f"{LAGS_CTE} SELECT {columns(*KEYS, 'total_sales', *LAGS)} FROM features",
    "feature_lags_of_calendar": f"""{MONTHLY_CTE},
kept AS (SELECT *, year * 12 + month - 1 AS m FROM monthly WHERE (year * 12 + month + LENGTH(region)) % 7 <> 3),
spine AS (SELECT region, category, UNNEST(RANGE(MIN(m), MAX(m) + 1)) AS m FROM kept GROUP BY 1, 2),
whole AS (SELECT CAST(s.m // 12 AS INTEGER) AS year, CAST(s.m % 12 + 1 AS INTEGER) AS month,
 CAST(s.m % 12 // 3 + 1 AS INTEGER) AS quarter, s.region, s.category, COALESCE(total_sales, 0) AS total_sales,
 COALESCE(order_count, 0) AS order_count FROM spine s LEFT JOIN kept k ON k.region = s.region AND k.category = s.category AND k.m = s.m),
lagged AS (SELECT *, LAG(total_sales, 1) {SERIES} AS lag_1_sales, LAG(total_sales, 2) {SERIES} AS lag_2_sales,
 LAG(total_sales, 3) {SERIES} AS lag_3_sales FROM whole)
SELECT *, ROUND((lag_1_sales + lag_2_sales + lag_3_sales) / 3, 4) AS rolling_3avg FROM lagged""",
    "feature_matrix": f"{MATRIX_CTE} SELECT "
    f"{columns(*KEYS, *MEASURES, *LAGS, *SEASONS, *ENCODED)} FROM matrix",
    "train_test_split": f"{MATRIX_CTE} SELECT {columns(*KEYS, 'total_sales', 'is_test')} FROM split",
    "scaled_features": f"{MATRIX_CTE} SELECT {columns(*KEYS, 'is_test')}, "
    f"{', '.join(score(c) for c in FEATURES)} FROM split",
    "forecast_metrics": f"{MATRIX_CTE} SELECT is_test, {METRICS} FROM split GROUP BY is_test",
    "forecast_naive_metrics": f"{MATRIX_CTE} SELECT {METRICS} FROM split WHERE is_test",
    "kpi_cards": f"""{WITH_SALES}, {MONTHLY}, last AS (SELECT *, {GROWTH} AS g FROM growth
 ORDER BY yr DESC, mth DESC LIMIT 1)
SELECT 'total_orders' AS kpi, CAST(COUNT(DISTINCT order_id) AS DOUBLE) AS value FROM sales
UNION ALL SELECT 'total_customers', CAST(COUNT(DISTINCT customer_id) AS DOUBLE) FROM sales
UNION ALL SELECT 'total_revenue', {TOTAL_SALES} FROM sales
UNION ALL SELECT 'total_profit', {TOTAL_PROFIT} FROM sales
UNION ALL SELECT 'total_units_sold', CAST(SUM(quantity) AS DOUBLE) FROM sales
UNION ALL SELECT 'profit_margin_pct', {MARGIN} FROM sales
UNION ALL SELECT 'latest_mom_growth_pct', g FROM last
UNION ALL SELECT 'latest_month_sales', monthly_sales FROM last
UNION ALL SELECT 'region_sales: ' || region, {TOTAL_SALES} FROM sales GROUP BY region""",
    "kpi_drill_cube": f"{WITH_SALES} " + " UNION ALL ".join(
        [level("total"), level("region", "region"), level("category", "category"),
         level("segment", "segment")]
    ),
    "monthly_year_compare": f"""{WITH_SALES}, m AS (
SELECT CAST(MONTH(order_date) AS INTEGER) AS month, {year_sum(2000)} AS sales_current,
       {year_sum(1999)} AS sales_prior
FROM sales WHERE YEAR(order_date) IN (1999, 2000) GROUP BY 1)
SELECT *, {half_up("sales_current - sales_prior")} AS change,
       {pct("sales_current - sales_prior", "sales_prior")} AS change_pct FROM m""",
}

# The same rows, answered from a stored rollup.
ORACLES |= {
    "kpi_cards_rollup": ORACLES["kpi_cards"],
    "kpi_drill_rollup": ORACLES["kpi_drill_cube"],
    "monthly_year_compare_rollup": ORACLES["monthly_year_compare"],
}
