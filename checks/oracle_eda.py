"""Comparison SQL of the exploratory tables."""

from __future__ import annotations

from itertools import combinations

from checks.oracle_base import half_up, pct, ratio
from checks.oracle_cleaning import CLEANED_CTE

WITH = CLEANED_CTE


def money(x: str) -> str:
    return f"COALESCE(CAST(SUM(CAST({x} AS DECIMAL(18,4))) AS DOUBLE), 0)"


def even(x: str, places: int = 0) -> str:
    return f"round_even({x}, {places})"


SALES, PROFIT = money("sales"), money("profit")
YEARS = list(range(1995, 2002))
REGIONS = ["Africa", "America", "Asia", "Europe", "Middle East"]
NUMBERS = [
    "sales", "quantity", "discount", "profit", "profit_margin_pct", "days_to_ship",
    "revenue_per_unit",
]


def limits(name: str, x: str, table: str) -> str:
    return (
        f"{name} AS (SELECT lo - CASE WHEN lo = hi THEN 0.5 ELSE 0 END::DOUBLE AS lo, "
        f"hi + CASE WHEN lo = hi THEN 0.5 ELSE 0 END::DOUBLE AS hi "
        f"FROM (SELECT MIN({x}) AS lo, MAX({x}) AS hi FROM {table}))"
    )


def bin_of(x: str, lim: str, n: int) -> str:
    return f"CAST(LEAST(FLOOR(({x} - {lim}.lo) / (({lim}.hi - {lim}.lo) / {n}::DOUBLE)), {n - 1}) AS INTEGER)"


def edge(i: str, lim: str, n: int) -> str:
    return f"{lim}.lo + {i} * (({lim}.hi - {lim}.lo) / {n}::DOUBLE)"


def histogram(x: str, n: int) -> str:
    return f"""{WITH}, v AS (SELECT {x} AS x FROM cleaned_sales WHERE sales IS NOT NULL),
{limits("lim", "x", "v")},
c AS (SELECT {bin_of("x", "lim", n)} AS bin, COUNT(*) AS n FROM v, lim GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, {edge("i", "lim", n)} AS bin_start, {edge("(i + 1)", "lim", n)} AS bin_end,
       COALESCE(n, 0) AS count
FROM range({n}) r(i) CROSS JOIN lim LEFT JOIN c ON c.bin = i"""


QUARTERLY = f"""quarterly AS (SELECT year, quarter, {SALES} AS sales, {PROFIT} AS profit
FROM cleaned_sales GROUP BY year, quarter)"""
SHARE = f"""by_category AS (SELECT category, {SALES} AS sales FROM cleaned_sales
WHERE category IS NOT NULL GROUP BY category), share AS (
SELECT category, sales, {even("sales / SUM(sales) OVER () * 100", 1)} AS pct FROM by_category)"""


def pair(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    sd = f"(STDDEV_POP({x}) FILTER ({both}) * STDDEV_POP({y}) FILTER ({both}))"
    return (
        f"SELECT '{x}' AS x, '{y}' AS y, ROUND(COVAR_POP({x}, {y}) / NULLIF({sd}, 0), 6) AS corr "
        "FROM cleaned_sales"
    )


def region_name(r: str) -> str:
    return r.lower().replace(" ", "_")


def region_sum(r: str) -> str:
    return money(f"CASE WHEN region = '{r}' THEN sales END")


def best(key: str) -> str:
    return (
        f"(SELECT {key} FROM cleaned_sales WHERE {key} IS NOT NULL GROUP BY {key} "
        f"ORDER BY {SALES} DESC, {key} LIMIT 1)"
    )


def avg_profit(condition: str) -> str:
    x = f"CASE WHEN {condition} THEN profit END"
    return half_up(ratio(money(x), f"COUNT({x})"))


MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"

ORACLES = {
    "eda_sales_hist": histogram("sales", 60),
    "eda_log_sales_hist": f"""SELECT bin, ROUND(bin_start, 9) AS bin_start, ROUND(bin_end, 9) AS bin_end, count
FROM ({histogram("LN(1 + sales)", 50)})""",
    "eda_monthly_trend": f"""{WITH} SELECT year, month, {SALES} AS sales,
 MAKE_DATE(year, month, 1) AS period, month >= 10 AS in_q4
FROM cleaned_sales GROUP BY year, month""",
    "eda_quarterly": f"""{WITH}, {QUARTERLY}
SELECT *, 'Q' || quarter || ' ' || year AS label FROM quarterly""",
    "eda_quarter_pivot": f"{WITH}, {QUARTERLY} SELECT quarter, " + ", ".join(
        f"MAX(CASE WHEN year = {y} THEN sales END) AS sales_{y}" for y in YEARS
    ) + " FROM quarterly GROUP BY quarter",
    "eda_category_share": f"{WITH}, {SHARE} SELECT * FROM share",
    "eda_top2_share": f"""{WITH}, {SHARE} SELECT {even("SUM(pct)", 1)} AS top_pct FROM
(SELECT pct FROM share ORDER BY sales DESC, category LIMIT 2)""",
    "eda_subcat_region": f"{WITH} SELECT sub_category, " + ", ".join(
        f"{region_sum(r)} AS {region_name(r)}, {even(region_sum(r) + ' / 1000')} AS {region_name(r)}_k"
        for r in REGIONS
    ) + ", 0.0::DOUBLE + " + " + ".join(region_sum(r) for r in REGIONS)
    + " AS total FROM cleaned_sales WHERE sub_category IS NOT NULL GROUP BY sub_category",
    "eda_regional": f"""{WITH} SELECT region, {SALES} AS sales, {PROFIT} AS profit,
 COUNT(DISTINCT order_id) AS orders, {even(f"{PROFIT} / NULLIF({SALES}, 0) * 100", 1)} AS profit_margin
FROM cleaned_sales WHERE region IS NOT NULL GROUP BY region""",
    "eda_correlation": f"{WITH} " + " UNION ALL ".join(
        pair(x, y) for y, x in combinations(NUMBERS, 2)
    ),
    "eda_discount_profit_bins": f"""{WITH}, p AS (SELECT discount, profit, sales FROM cleaned_sales
 WHERE discount IS NOT NULL AND profit IS NOT NULL),
{limits("dl", "discount", "p")}, {limits("pl", "profit", "p")},
cells AS (SELECT {bin_of("discount", "dl", 20)} AS discount_bin, {bin_of("profit", "pl", 40)} AS profit_bin,
 COUNT(*) AS lines, {half_up(ratio(SALES, "COUNT(sales)"))} AS avg_sales FROM p, dl, pl GROUP BY 1, 2)
SELECT discount_bin, profit_bin, {edge("discount_bin", "dl", 20)} AS discount_start,
 {edge("profit_bin", "pl", 40)} AS profit_start, lines, avg_sales FROM cells, dl, pl""",
    "eda_segment": f"""{WITH} SELECT segment, {SALES} AS sales, {PROFIT} AS profit,
 COUNT(DISTINCT customer_id) AS customers, COUNT(DISTINCT order_id) AS orders,
 {SALES} / COUNT(DISTINCT order_id) AS avg_order
FROM cleaned_sales WHERE segment IS NOT NULL GROUP BY segment""",
    "eda_overview": f"""{WITH} SELECT COUNT(*) AS records, COUNT(DISTINCT order_id) AS orders,
 COUNT(DISTINCT customer_id) AS customers, MIN(order_date) AS first_date, MAX(order_date) AS last_date,
 {SALES} AS revenue, {PROFIT} AS profit, {pct(PROFIT, SALES, 1)} AS margin_pct FROM cleaned_sales""",
    "eda_top_performers": f"""{WITH}, t AS (SELECT {best("region")} AS top_region,
 {best("category")} AS top_category, {best("month")} AS peak_month)
SELECT top_region, top_category,
 {half_up("(SELECT " + SALES + " FROM cleaned_sales WHERE category = top_category) / "
          "(SELECT " + SALES + " FROM cleaned_sales) * 100", 1)} AS top_category_pct,
 peak_month, {MONTHS}[peak_month] AS peak_month_name FROM t""",
    "eda_discount_risk": f"""{WITH} SELECT {avg_profit("discount > 0.3::DOUBLE")} AS avg_profit_high_discount,
 {avg_profit("discount <= 0.1::DOUBLE")} AS avg_profit_low_discount FROM cleaned_sales""",
    "eda_q4_peak_check": f"""{WITH}, {QUARTERLY}, r AS (SELECT year, quarter,
 ROW_NUMBER() OVER (PARTITION BY year ORDER BY sales DESC, quarter) AS n FROM quarterly)
SELECT year, quarter AS peak_quarter, quarter = 4 AS q4_is_peak FROM r WHERE n = 1""",
}
