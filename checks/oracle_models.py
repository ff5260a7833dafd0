"""Comparison SQL of the linear models: least squares from sums of products, by elimination.

The rolling mean is the mean of three other inputs. Least squares gives the same predictions
without it; the penalty of ridge makes the whole set solvable.
"""

from __future__ import annotations

from checks.oracle_forecast import KEYS, MATRIX_CTE
from tillroll.operators.features import FEATURES
from tillroll.operators.forecast import ALPHA, FOLDS, KNOWN_AHEAD, LINEAR, RIDGE

INDEPENDENT = [c for c in FEATURES if c != "rolling_3avg"]
SHOWN = ", ".join(KEYS)


def scaled(inputs: list[str], source: str = "split") -> str:
    """The inputs of each row as standard scores of the training rows, in one list."""
    scores = ", ".join(f"CAST(({c} - {c}_m) / {c}_s AS DOUBLE)" for c in inputs)
    return f"[{scores}] AS x FROM {source}, moments"


def rows(inputs: list[str]) -> str:
    moments = ", ".join(
        f"AVG({c}) AS {c}_m, COALESCE(NULLIF(STDDEV_POP({c}), 0), 1) AS {c}_s" for c in inputs
    )
    return f"""{MATRIX_CTE}, moments AS MATERIALIZED (SELECT {moments} FROM split WHERE NOT is_test),
z AS MATERIALIZED (SELECT {SHOWN}, total_sales, is_test, ROW_NUMBER() OVER (ORDER BY {SHOWN}) AS rid,
 (year * 12 + month + region_enc) % {FOLDS} AS fold, {scaled(inputs)})"""


def solved(name: str, size: int, alpha: float, fits: str, seen: str, cells: str = "") -> str:
    """``<name>_w`` (fit, i, w) and ``<name>_b`` (fit, b): one regression for each fit of ``fits``.

    ``seen`` says which rows of z a fit learns from. ``cells`` gives (fit, rid, i, v) in their place:
    inputs by number, and after the last one the sales.
    """
    y = size + 1
    cells = cells or f"""SELECT fit, rid, UNNEST(RANGE(1, {y + 1})) AS i,
 UNNEST(LIST_APPEND(x, CAST(total_sales AS DOUBLE))) AS v FROM z, {fits} WHERE {seen}"""
    out = f""", {name}_c AS MATERIALIZED ({cells}),
{name}_m AS MATERIALIZED (SELECT fit, i, AVG(v) AS m FROM {name}_c GROUP BY 1, 2),
{name}_d AS MATERIALIZED (SELECT fit, rid, i, v - m AS v FROM {name}_c JOIN {name}_m USING (fit, i)),
{name}_0 AS MATERIALIZED (SELECT a.fit, a.i, b.i AS j,
 SUM(a.v * b.v) + CASE WHEN a.i = b.i THEN {alpha} ELSE 0 END AS v
 FROM {name}_d a JOIN {name}_d b ON a.fit = b.fit AND a.rid = b.rid WHERE a.i < {y} GROUP BY 1, 2, 3)"""
    for k in range(1, y):
        t = f"{name}_{k - 1}"
        out += f""",
{name}_{k} AS MATERIALIZED (SELECT r.fit, r.i, r.j,
 CASE WHEN r.i = {k} THEN r.v / p.v ELSE r.v - c.v * q.v / p.v END AS v FROM {t} r
 JOIN {t} c ON c.fit = r.fit AND c.i = r.i AND c.j = {k}
 JOIN {t} q ON q.fit = r.fit AND q.i = {k} AND q.j = r.j
 JOIN {t} p ON p.fit = r.fit AND p.i = {k} AND p.j = {k} WHERE r.j > {k})"""
    return f"""{out},
{name}_w AS MATERIALIZED (SELECT fit, i, v AS w FROM {name}_{size} WHERE j = {y}),
{name}_b AS MATERIALIZED (SELECT fit, MAX(CASE WHEN i = {y} THEN m END)
 - SUM(CASE WHEN i < {y} THEN w * m ELSE 0 END) AS b
 FROM {name}_m LEFT JOIN {name}_w USING (fit, i) GROUP BY 1)"""


def predicted(name: str, source: str, columns: str, where: str = "TRUE") -> str:
    """Rows of ``source`` with the prediction of each fit."""
    return f"""SELECT {columns}, b + (SELECT SUM(w * x[i]) FROM {name}_w w WHERE w.fit = f.fit) AS prediction
FROM {source}, {name}_b f WHERE {where}"""


def one(name: str, inputs: list[str], alpha: float) -> str:
    return solved(name, len(inputs), alpha, "(SELECT 0 AS fit)", "NOT is_test")


def model(name: str, inputs: list[str], alpha: float) -> str:
    fitted = rows(inputs) + one(name, inputs, alpha)
    return f"{fitted}, p AS ({predicted(name, 'z', f'{SHOWN}, total_sales', 'is_test')})"




def residuals(places: int) -> str:
    return f"""SELECT {SHOWN}, total_sales AS actual, ROUND(prediction, {places}) AS predicted,
 ROUND(total_sales - prediction, {places}) AS residual FROM p"""


R2 = "1 - AVG((total_sales - prediction) ** 2) / VAR_POP(total_sales)"


def compared(name: str, label: str, inputs: list[str], alpha: float, share: int, money: int) -> str:
    """One row: quality on the test rows, and the mean R² of the folds."""
    fits = solved("fold", len(inputs), alpha, f"(SELECT UNNEST(RANGE({FOLDS})) AS fit)", "NOT is_test AND fold <> fit")
    left = predicted("fold", "z", "f.fit, total_sales", "NOT is_test AND fold = f.fit")
    return f"""{model(name, inputs, alpha)}{fits}, q AS ({left}),
r AS (SELECT fit, {R2} AS r2 FROM q GROUP BY 1)
SELECT '{label}' AS model, ROUND({R2}, {share}) AS r2, ROUND(AVG(ABS(total_sales - prediction)), {money}) AS mae,
 ROUND(SQRT(AVG((total_sales - prediction) ** 2)), {money}) AS rmse,
 (SELECT ROUND(AVG(r2), {share}) FROM r) AS cv_r2 FROM p"""


LATEST = f"""SELECT region, category, region_enc, category_enc, MAX(year * 12 + month - 1) AS last,
 MAX_BY(total_sales, year * 12 + month) AS lag_1_sales, MAX_BY(lag_1_sales, year * 12 + month) AS lag_2_sales,
 MAX_BY(lag_2_sales, year * 12 + month) AS lag_3_sales FROM split GROUP BY 1, 2, 3, 4"""
BANDS = f"""{rows(KNOWN_AHEAD)}{one("ols", KNOWN_AHEAD, 0.0)}, last_rows AS ({LATEST}),
next_months AS (SELECT *, (last + 1) // 12 AS year, (last + 1) % 12 + 1 AS month FROM last_rows
 WHERE last = (SELECT MAX(last) FROM last_rows)),
upcoming AS (SELECT *, (month + 2) // 3 AS quarter, CAST(month >= 10 AS INTEGER) AS is_q4,
 CAST(month >= 11 AS INTEGER) AS is_holiday FROM next_months),
ahead AS (SELECT year, month, region, category, {scaled(KNOWN_AHEAD, "upcoming")}),
test AS ({predicted("ols", "z", "total_sales", "is_test")}),
band AS (SELECT 1.96 * STDDEV_POP(total_sales - prediction) AS band FROM test),
p AS ({predicted("ols", "ahead", "year, month, region, category")})
SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, region, category,
 ROUND(prediction, 1) AS forecast, ROUND(prediction - band, 1) AS lower, ROUND(prediction + band, 1) AS upper
FROM p, band"""

NAMES = ", ".join(f"'{c}'" for c in FEATURES)
ORACLES = {
    "forecast_linear": f"{model('ols', INDEPENDENT, 0.0)} {residuals(0)}",
    "forecast_ridge": f"{model('ridge', FEATURES, ALPHA)} {residuals(4)}",
    "forecast_linear_quality": compared("ols", LINEAR, INDEPENDENT, 0.0, 7, 2),
    "forecast_ridge_quality": compared("ridge", RIDGE, FEATURES, ALPHA, 9, 4),
    "forecast_ridge_line": f"""{model('ridge', FEATURES, ALPHA)} SELECT
 ROUND(LEAST(MIN(total_sales), MIN(prediction)), 4) AS lowest,
 ROUND(GREATEST(MAX(total_sales), MAX(prediction)), 4) AS highest FROM p""",
    "forecast_ridge_importance": f"""{rows(FEATURES)}{one('ridge', FEATURES, ALPHA)}
SELECT [{NAMES}][i] AS feature, ROUND(ABS(w), 4) AS importance,
 ABS(w) >= (SELECT MEDIAN(ABS(w)) FROM ridge_w) AS is_major FROM ridge_w""",
    "forecast_bands": BANDS,
}
