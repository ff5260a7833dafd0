"""Comparison SQL of the quality and cleaning operators."""

from __future__ import annotations

from checks.oracle_base import COLUMNS, SALES_LINES
from tillroll.schema import (
    BROKEN_QUOTES, CANONICAL_COLUMNS, CATEGORICAL, DATES, EXTRA_CELLS, FAULTS, MISSING_CELLS, NUMERIC, TEXT,
)

STRINGS = ["order_id", "customer_id"] + CATEGORICAL + TEXT

RAW_CTE = f"""WITH b AS ({SALES_LINES}), x AS (
SELECT order_id,
  CASE WHEN k%101=0 THEN NULL ELSE order_date END AS order_date,
  CASE WHEN k%103=0 THEN NULL
       WHEN ship_date<order_date AND k%10<>0 THEN order_date ELSE ship_date END AS ship_date,
  CASE WHEN k%53=0 THEN NULL ELSE ship_mode END AS ship_mode,
  customer_id,
  CASE WHEN k%61=0 THEN NULL ELSE customer_name END AS customer_name,
  CASE WHEN k%47=0 THEN NULL WHEN k%3=0 THEN concat('  ',lower(segment),' ') ELSE segment END AS segment,
  CASE WHEN k%43=0 THEN NULL ELSE region END AS region,
  state,
  CASE WHEN k%59=0 THEN NULL WHEN k%5=0 THEN upper(category) ELSE lower(category) END AS category,
  sub_category, product_name,
  CASE WHEN k%41=0 THEN NULL WHEN k%67=0 THEN -CAST(sales AS DOUBLE)
       WHEN k%71=0 THEN CAST(sales AS DOUBLE)*50 ELSE CAST(sales AS DOUBLE) END AS sales,
  CASE WHEN k%37=0 THEN NULL WHEN k%73=0 THEN -1.0
       WHEN k%79=0 THEN quantity+0.5 ELSE CAST(quantity AS DOUBLE) END AS quantity,
  CASE WHEN k%83=0 THEN NULL WHEN k%89=0 THEN 1.5 ELSE CAST(discount AS DOUBLE) END AS discount,
  CASE WHEN k%31=0 THEN NULL ELSE CAST(profit AS DOUBLE) END AS profit,
  k FROM b), raw_sales AS (
SELECT {COLUMNS} FROM x UNION ALL SELECT {COLUMNS} FROM x WHERE k%50=7)"""

DEDUP = f"{RAW_CTE}, uniq AS (SELECT DISTINCT * FROM raw_sales)"


def select_with(changes: dict[str, str], table: str) -> str:
    """SELECT every canonical column from the table, some replaced by an expression."""
    return "SELECT " + ", ".join(
        f"{changes[c]} AS {c}" if c in changes else c for c in CANONICAL_COLUMNS
    ) + f" FROM {table}"


def mode(c: str) -> str:
    return (
        f"(SELECT {c} FROM uniq WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"
    )


def quantile(c: str, q: float, table: str) -> str:
    """Linear interpolation between the two neighbours of position (n - 1) * q."""
    return f"(SELECT QUANTILE_CONT({c}, {q}) FROM {table})"


def title(c: str) -> str:
    stripped = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return (
        rf"array_to_string(list_transform(regexp_extract_all(lower({stripped}), '[\p{{L}}]+|[^\p{{L}}]+'),"
        r" lambda w: upper(w[1])||w[2:]), '')"
    )


MEDIANS = {c: f"COALESCE({c}, {quantile(c, 0.5, 'uniq')})" for c in NUMERIC}
MODES = {c: f"COALESCE({c}, {mode(c)})" for c in CATEGORICAL}
FILLS = {c: f"COALESCE({c}, 'Unknown')" for c in TEXT}
TITLES = {c: title(c) for c in STRINGS}
RULES = {
    "quantity": "CAST(CASE WHEN quantity IS NULL THEN NULL "
    "ELSE round_even(GREATEST(quantity, 1), 0) END AS BIGINT)",
    "discount": "CASE WHEN discount IS NULL THEN NULL ELSE LEAST(GREATEST(discount, 0.0), 1.0) END",
}
DATED = "order_date IS NOT NULL AND ship_date IS NOT NULL"
VALID_SALES = "(sales > 0 OR sales IS NULL)"
VALID_DATES = "(ship_date >= order_date OR ship_date IS NULL OR order_date IS NULL)"


def bounds(table: str) -> str:
    q1, q3 = quantile("sales", 0.25, table), quantile("sales", 0.75, table)
    return (
        f"bounds AS (SELECT q1 - (q3 - q1) * 3.0::DOUBLE AS lo, q3 + (q3 - q1) * 3.0::DOUBLE AS hi "
        f"FROM (SELECT {q1} AS q1, {q3} AS q3))"
    )


CAPPED = {
    "sales": "CASE WHEN sales IS NULL THEN NULL "
    "ELSE LEAST(GREATEST(sales, (SELECT lo FROM bounds)), (SELECT hi FROM bounds)) END"
}
DERIVED = """CAST(YEAR(order_date) AS INTEGER) AS year, CAST(MONTH(order_date) AS INTEGER) AS month,
 CAST(QUARTER(order_date) AS INTEGER) AS quarter, DAYNAME(order_date) AS day_of_week,
 CAST(DATE_DIFF('day', order_date, ship_date) AS INTEGER) AS days_to_ship,
 profit / NULLIF(sales, 0) * 100 AS profit_margin_pct,
 sales / NULLIF(CAST(quantity AS DOUBLE), 0) AS revenue_per_unit"""

CLEANED_CTE = f"""{DEDUP},
imputed AS ({select_with(MEDIANS | MODES, "uniq")}),
dated AS ({select_with(FILLS, "imputed")} WHERE {DATED}),
titled AS ({select_with(TITLES, "dated")}),
valid AS ({select_with(RULES, "titled")} WHERE {VALID_SALES}),
{bounds("valid")},
capped AS ({select_with(CAPPED, "valid")} WHERE {VALID_DATES}),
cleaned_sales AS (SELECT *, {DERIVED} FROM capped)"""


def missing(c: str, table: str) -> str:
    return f"(SELECT COUNT(*) FROM {table} WHERE {c} IS NULL)"


def all_missing(columns: list[str], table: str) -> str:
    return f"(SELECT {' + '.join(f'COUNT(*) - COUNT({c})' for c in columns)} FROM {table})"


CLEANED_COLUMNS = CANONICAL_COLUMNS + [
    "year", "month", "quarter", "day_of_week", "days_to_ship", "profit_margin_pct",
    "revenue_per_unit",
]


def report(label: str, columns: list[str], table: str) -> str:
    return f"""SELECT '{label}' AS stage, (SELECT COUNT(*) FROM {table}) AS rows,
 {len(columns)} AS columns, CAST({all_missing(columns, table)} AS BIGINT) AS total_missing,
 (SELECT COUNT(*) FROM {table}) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {table})) AS duplicate_rows"""


AUDIT = [
    ("drop_duplicates", "*", "(SELECT COUNT(*) FROM raw_sales) - (SELECT COUNT(*) FROM uniq)"),
    ("repeated_orders", "order_id",
     "(SELECT COUNT(*) FROM (SELECT order_id FROM uniq GROUP BY order_id HAVING COUNT(*) > 1))"),
    *[("fill_median", c, missing(c, "uniq")) for c in NUMERIC],
    *[("fill_mode", c, missing(c, "uniq")) for c in CATEGORICAL],
    ("drop_null_dates", "*", f"(SELECT COUNT(*) FROM uniq WHERE NOT ({DATED}))"),
    ("drop_nonpositive_sales", "sales", "(SELECT COUNT(*) FROM dated WHERE sales <= 0)"),
    ("cap_outliers", "sales", "(SELECT COUNT(*) FROM valid, bounds WHERE sales < lo OR sales > hi)"),
    ("drop_inverted_dates", "ship_date", "(SELECT COUNT(*) FROM valid WHERE ship_date < order_date)"),
]

K = "CAST(order_id AS BIGINT)"
BAD_DATE = {c: f"({K} % 31 = 2 AND {K} % 29 <> 1 AND {c} IS NOT NULL)" for c in DATES}
SPOILED = {"sales": 23, "quantity": 37, "discount": 41, "profit": 43}
BAD = BAD_DATE | {c: f"({K} % {n} = 4 OR ({K} % {n} = 3 AND {c} IS NOT NULL))" for c, n in SPOILED.items()}
PARSED = {c: f"CASE WHEN {BAD[c]} THEN NULL ELSE {c} END" for c in DATES} | {
    c: f"CASE WHEN {BAD[c]} OR {K} % {n} = 5 THEN NULL ELSE {c} END" for c, n in SPOILED.items()
}
# Which lines of the raw file have the wrong shape, and the cells that are not there.
MALFORMED = dict.fromkeys([*DATES, "sales"], "7") | dict.fromkeys(["quantity", "discount", "profit"], "6, 7")
MALFORMED |= {EXTRA_CELLS: "5", MISSING_CELLS: "6", BROKEN_QUOTES: "7"}
NAMES = ", ".join(f"CASE WHEN {bad} THEN '{c}' END" for c, bad in BAD.items())

ORACLES = {
    "raw_parsed": f"""{RAW_CTE}, named AS (SELECT *, CONCAT_WS(',', {NAMES}) AS unreadable FROM raw_sales)
{select_with(PARSED, "named").replace(" FROM named", ", unreadable FROM named")}""",
    "raw_unreadable": f"{RAW_CTE} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {bad}) AS cells FROM raw_sales"
        for c, bad in (BAD | dict.fromkeys(FAULTS, "FALSE")).items()
    ),
    "raw_malformed": f"{RAW_CTE} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {K} % 97 IN ({at})) AS cells FROM raw_sales"
        for c, at in MALFORMED.items()
    ),
    "quality_report_cleaned": f"{CLEANED_CTE} {report('CLEANED', CLEANED_COLUMNS, 'cleaned_sales')}",
    "quality_report": f"{RAW_CTE} {report('RAW', CANONICAL_COLUMNS, 'raw_sales')}",
    "quality_missing": f"{RAW_CTE} " + " UNION ALL ".join(
        f"SELECT 'RAW' AS stage, '{c}' AS \"column\", {missing(c, 'raw_sales')} AS missing"
        for c in CANONICAL_COLUMNS
    ),
    "clean_dedup": f"{DEDUP} SELECT * FROM uniq",
    "dup_order_ids": f"""{DEDUP} SELECT COUNT(*) AS repeated_order_ids FROM
(SELECT order_id FROM uniq GROUP BY order_id HAVING COUNT(*) > 1)""",
    "clean_impute_numeric": f"{DEDUP} {select_with(MEDIANS, 'uniq')}",
    "clean_impute_categorical": f"{DEDUP} {select_with(MODES, 'uniq')}",
    "clean_drop_null_dates": f"{RAW_CTE} SELECT * FROM raw_sales WHERE {DATED}",
    "clean_fill_text": f"{RAW_CTE} {select_with(FILLS, 'raw_sales')}",
    "clean_standardise": f"{RAW_CTE} {select_with(TITLES, 'raw_sales')}",
    "clean_valid_sales": f"{RAW_CTE} SELECT * FROM raw_sales WHERE {VALID_SALES}",
    "clean_numeric_rules": f"{RAW_CTE} {select_with(RULES, 'raw_sales')}",
    "clean_iqr_cap": f"""{RAW_CTE}, valid AS (SELECT * FROM raw_sales WHERE {VALID_SALES}),
{bounds("valid")} {select_with(CAPPED, "valid")}""",
    "clean_valid_dates": f"{RAW_CTE} SELECT * FROM raw_sales WHERE {VALID_DATES}",
    "clean_derived": f"{RAW_CTE} SELECT *, {DERIVED} FROM raw_sales",
    "cleaned_sales": f"{CLEANED_CTE} SELECT * FROM cleaned_sales",
    "quality_summary": f"""{CLEANED_CTE}, q AS (SELECT
 (SELECT COUNT(*) FROM raw_sales) AS rows_before, (SELECT COUNT(*) FROM cleaned_sales) AS rows_after,
 CAST({all_missing(CANONICAL_COLUMNS, "raw_sales")} AS BIGINT) AS missing_before,
 CAST({all_missing(CLEANED_COLUMNS, "cleaned_sales")} AS BIGINT) AS missing_after,
 (SELECT COUNT(*) FROM raw_sales) - (SELECT COUNT(*) FROM uniq) AS duplicate_rows_removed)
SELECT rows_before, rows_after, rows_before - rows_after AS rows_removed, missing_before, missing_after,
 round_even((missing_before - missing_after)::DOUBLE / GREATEST(missing_before, 1) * 100, 1) AS accuracy_gain,
 duplicate_rows_removed FROM q""",
    "cleaning_audit": f"{CLEANED_CTE} " + " UNION ALL ".join(
        f"SELECT '{s}' AS step, '{c}' AS \"column\", {n} AS affected" for s, c, n in AUDIT
    ),
}
