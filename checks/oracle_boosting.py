"""Comparison SQL of gradient boosting: split search in histograms, a few rounds of it.

Bins, gains, leaf means and residuals are worked out from the rows alone, with nothing taken
from the model compared.
"""

from __future__ import annotations

from checks.oracle_forecast import MATRIX_CTE, ROUNDED
from checks.oracle_models import FEATURES, INDEPENDENT, R2, SHOWN, compared, solved
from tillroll.operators.forecast import ALPHA, BOOSTED, FEW_ROUNDS, FOLDS, HORIZON, LINEAR, NAIVE, ORIGINS, RIDGE

BINS = 128
WHOLE = -1  # the fit that learns from all training rows; the others leave a fold out
SEEN = "NOT is_test AND fold <> fit"


def binned() -> str:
    """``train`` and ``bins`` (fit, rid, i, bin): each input as the number of thresholds below it.

    Thresholds lie half way between neighbouring values. Inputs with more than ``BINS`` values
    have them where the rows counted so far come closest to the next multiple of n / BINS; a
    place taken already moves the later ones on, which the running maximum says.
    """
    rounded = {c: f"ROUND({c}, {ROUNDED[c]})" for c in FEATURES if c in ROUNDED}
    inputs = ", ".join(f"CAST({rounded.get(c, c)} AS DOUBLE)" for c in FEATURES)
    return f"""{MATRIX_CTE}, z AS MATERIALIZED (SELECT {SHOWN}, total_sales, is_test,
 (year * 12 + month + region_enc) % {FOLDS} AS fold, ROW_NUMBER() OVER (ORDER BY {SHOWN}) AS rid, [{inputs}] AS x FROM split),
fits AS (SELECT UNNEST(RANGE({WHOLE}, {FOLDS})) AS fit),
long AS MATERIALIZED (SELECT rid, UNNEST(RANGE(1, {len(FEATURES) + 1})) AS i, UNNEST(x) AS value FROM z),
seen AS MATERIALIZED (SELECT fit, rid, CAST(total_sales AS DOUBLE) AS y FROM z, fits WHERE {SEEN}),
counted AS (SELECT fit, i, value, COUNT(*) AS c FROM long JOIN seen USING (rid) GROUP BY 1, 2, 3),
ordered AS MATERIALIZED (SELECT fit, i, value, ROW_NUMBER() OVER w AS pos, SUM(c) OVER w AS upto, SUM(c) OVER w - c AS before,
 LAG(value) OVER w AS last, COUNT(*) OVER (PARTITION BY fit, i) AS kinds, SUM(c) OVER (PARTITION BY fit, i) AS n
 FROM counted WINDOW w AS (PARTITION BY fit, i ORDER BY value)),
wanted AS (SELECT fit, i, k, (SELECT MIN(pos) FROM ordered o WHERE o.fit = g.fit AND o.i = g.i AND pos > 1
  AND (before + upto) / 2.0 > k * n / {BINS}.0) AS pos
 FROM (SELECT DISTINCT fit, i FROM ordered WHERE kinds > {BINS}) g, (SELECT UNNEST(RANGE(1, {BINS})) AS k)),
placed AS (SELECT fit, i, k + MAX(pos - k) OVER (PARTITION BY fit, i ORDER BY k) AS pos FROM wanted WHERE pos IS NOT NULL),
limits AS MATERIALIZED (SELECT fit, i, (last + value) / 2 AS t FROM ordered WHERE kinds <= {BINS} AND pos > 1
 UNION ALL SELECT fit, i, (last + value) / 2 FROM ordered JOIN placed USING (fit, i, pos)),
bins AS MATERIALIZED (SELECT fit, rid, i, COUNT(*) FILTER (WHERE t < value) AS bin
 FROM long JOIN limits USING (i) GROUP BY 1, 2, 3)"""


def boosted(rounds: int, depth: int, step: float, least: int) -> str:
    """``fitted`` (fit, rid, prediction): the sum of the trees, the later ones times ``step``.

    A tree is grown on twice the residual, level by level: the cut of a node is the one that
    takes most from the squared error and leaves ``least`` rows on both sides.
    """
    out = f"""{binned()},
p_0 AS (SELECT fit, rid, 0.0::DOUBLE AS prediction FROM z, fits)"""
    for r in range(1, rounds + 1):
        label = "y" if r == 1 else "2 * (y - prediction)"
        out += f""",
l_{r} AS MATERIALIZED (SELECT fit, rid, {label} AS l FROM seen JOIN p_{r - 1} USING (fit, rid)),
n_{r}_0 AS (SELECT fit, rid, 1 AS node FROM p_{r - 1})"""
        for d in range(1, depth + 1):
            name, above = f"{r}_{d}", f"n_{r}_{d - 1}"
            out += f""",
h_{name} AS (SELECT fit, node, i, bin, COUNT(*) AS c, SUM(l) AS s FROM l_{r} JOIN {above} USING (fit, rid)
 JOIN bins USING (fit, rid) GROUP BY 1, 2, 3, 4),
s_{name} AS (SELECT fit, node, i, bin, SUM(c) OVER w AS c, SUM(s) OVER w AS s, SUM(c) OVER v AS n, SUM(s) OVER v AS total
 FROM h_{name} WINDOW w AS (PARTITION BY fit, node, i ORDER BY bin), v AS (PARTITION BY fit, node, i)),
g_{name} AS (SELECT *, s * s / c + (total - s) * (total - s) / (n - c) - total * total / n AS gain
 FROM s_{name} WHERE c >= {least} AND n - c >= {least}),
b_{name} AS MATERIALIZED (SELECT fit, node, i, bin AS cut FROM g_{name} WHERE gain > 0
 QUALIFY ROW_NUMBER() OVER (PARTITION BY fit, node ORDER BY ROUND(gain, 3) DESC, i, bin) = 1),
n_{name} AS MATERIALIZED (SELECT a.fit, a.rid, 2 * a.node + COALESCE(CAST(x.bin > b.cut AS INTEGER), 0) AS node FROM {above} a
 LEFT JOIN b_{name} b USING (fit, node) LEFT JOIN bins x ON x.fit = a.fit AND x.rid = a.rid AND x.i = b.i)"""
        out += f""",
m_{r} AS (SELECT fit, node, AVG(l) AS mean FROM l_{r} JOIN n_{r}_{depth} USING (fit, rid) GROUP BY 1, 2),
p_{r} AS MATERIALIZED (SELECT fit, rid, prediction + {1.0 if r == 1 else step} * mean AS prediction
 FROM p_{r - 1} JOIN n_{r}_{depth} USING (fit, rid) JOIN m_{r} USING (fit, node))"""
    return f"{out}, fitted AS (SELECT * FROM p_{rounds})"


TREES = boosted(
    FEW_ROUNDS["maxIter"], FEW_ROUNDS["maxDepth"], FEW_ROUNDS["stepSize"], FEW_ROUNDS["minInstancesPerNode"]
)
SHARE, MONEY = 6, 1
ERROR = "(total_sales - prediction)"
QUALITY = f"""{TREES}, q AS (SELECT fit, total_sales, prediction, is_test FROM z JOIN fitted USING (rid)
 WHERE fit = {WHOLE} AND is_test OR fit = fold AND NOT is_test),
r AS (SELECT fit, {R2} AS r2, AVG(ABS({ERROR})) AS mae, SQRT(AVG({ERROR} ** 2)) AS rmse FROM q GROUP BY 1)
SELECT '{BOOSTED}' AS model, ROUND(r2, {SHARE}) AS r2, ROUND(mae, {MONEY}) AS mae, ROUND(rmse, {MONEY}) AS rmse,
 (SELECT ROUND(AVG(r2), {SHARE}) FROM r WHERE fit <> {WHOLE}) AS cv_r2 FROM r WHERE fit = {WHOLE}"""
COMPARED = " UNION ALL ".join(
    f"SELECT * FROM ({query})"
    for query in (
        compared("ols", LINEAR, INDEPENDENT, 0.0, SHARE, MONEY), compared("ridge", RIDGE, FEATURES, ALPHA, SHARE, MONEY), QUALITY,
    )
)


def inside_folds(label: str, inputs: list[str], alpha: float) -> str:
    """The mean R² of the folds, with scores by the rows each fold learns from."""
    y = len(inputs) + 1
    values = ", ".join(f"CAST({c} AS DOUBLE)" for c in inputs)
    scores = f"""SELECT fit, rid, i, v FROM scored WHERE {SEEN}
 UNION ALL SELECT fit, rid, {y}, CAST(total_sales AS DOUBLE) FROM z, fits WHERE {SEEN}"""
    return f"""{MATRIX_CTE}, z AS MATERIALIZED (SELECT {SHOWN}, total_sales, is_test,
 (year * 12 + month + region_enc) % {FOLDS} AS fold, ROW_NUMBER() OVER (ORDER BY {SHOWN}) AS rid, [{values}] AS x
 FROM split WHERE NOT is_test),
fits AS (SELECT UNNEST(RANGE({FOLDS})) AS fit),
long AS (SELECT rid, fold, is_test, UNNEST(RANGE(1, {y})) AS i, UNNEST(x) AS value FROM z),
moments AS (SELECT fit, i, AVG(value) AS m, COALESCE(NULLIF(STDDEV_SAMP(value), 0), 1) AS s
 FROM long, fits WHERE {SEEN} GROUP BY 1, 2),
scored AS MATERIALIZED (SELECT fit, rid, fold, is_test, i, (value - m) / s AS v FROM long JOIN moments USING (i))
{solved("fold", len(inputs), alpha, "", "", scores)},
q AS (SELECT fit, rid, total_sales, MAX(b) + SUM(w * v) AS prediction FROM scored JOIN fold_w USING (fit, i) JOIN fold_b USING (fit)
 JOIN z USING (rid) WHERE fit = scored.fold GROUP BY 1, 2, 3),
r AS (SELECT fit, {R2} AS r2 FROM q GROUP BY 1)
SELECT '{label}' AS model, ROUND(AVG(r2), {SHARE}) AS cv_r2 FROM r"""


ORIGIN = f"(SELECT MAX(number) FROM z) + 1 - {HORIZON} * ({ORIGINS} - fit)"
JUDGED = f"""ROUND({R2}, {SHARE}) AS r2, ROUND(AVG(ABS({ERROR})), {MONEY}) AS mae, ROUND(SQRT(AVG({ERROR} ** 2)), {MONEY}) AS rmse"""
DATE = "CAST(origin // 12 AS VARCHAR) || '-' || LPAD(CAST(origin % 12 + 1 AS VARCHAR), 2, '0') AS origin"


def rolling_origin(label: str, inputs: list[str], alpha: float) -> str:
    """Quality on the months from each origin on, learned from the months before it."""
    y = len(inputs) + 1
    values = ", ".join(f"CAST({c} AS DOUBLE)" for c in inputs)
    scores = f"""SELECT fit, rid, i, v FROM scored WHERE number < origin
 UNION ALL SELECT fit, rid, {y}, CAST(total_sales AS DOUBLE) FROM z, fits WHERE number < origin"""
    return f"""{MATRIX_CTE}, z AS MATERIALIZED (SELECT total_sales, year * 12 + month - 1 AS number,
 ROW_NUMBER() OVER (ORDER BY {SHOWN}) AS rid, [{values}] AS x FROM split),
fits AS MATERIALIZED (SELECT fit, {ORIGIN} AS origin FROM (SELECT UNNEST(RANGE({ORIGINS})) AS fit)),
long AS (SELECT rid, number, UNNEST(RANGE(1, {y})) AS i, UNNEST(x) AS value FROM z),
moments AS (SELECT fit, origin, i, AVG(value) AS m, COALESCE(NULLIF(STDDEV_SAMP(value), 0), 1) AS s
 FROM long, fits WHERE number < origin GROUP BY 1, 2, 3),
scored AS MATERIALIZED (SELECT fit, origin, rid, number, i, (value - m) / s AS v FROM long JOIN moments USING (i))
{solved("fold", len(inputs), alpha, "", "", scores)},
q AS (SELECT fit, origin, rid, MAX(z.total_sales) AS total_sales, MAX(b) + SUM(w * v) AS prediction FROM scored
 JOIN fold_w USING (fit, i) JOIN fold_b USING (fit) JOIN z USING (rid)
 WHERE scored.number BETWEEN origin AND origin + {HORIZON - 1} GROUP BY 1, 2, 3)
SELECT '{label}' AS model, {DATE}, COUNT(*) AS rows, {JUDGED} FROM q GROUP BY origin"""


MEAN_OF_THREE = f"""{MATRIX_CTE}, z AS (SELECT total_sales, rolling_3avg AS prediction, year * 12 + month - 1 AS number FROM split),
fits AS (SELECT {ORIGIN} AS origin FROM (SELECT UNNEST(RANGE({ORIGINS})) AS fit))
SELECT '{NAIVE}' AS model, {DATE}, COUNT(*) AS rows, {JUDGED} FROM z, fits
WHERE number BETWEEN origin AND origin + {HORIZON - 1} GROUP BY origin"""

ORACLES = {
    "forecast_rolling_origin": " UNION ALL ".join(
        f"SELECT * FROM ({query})"
        for query in (
            rolling_origin(LINEAR, INDEPENDENT, 0.0), rolling_origin(RIDGE, FEATURES, ALPHA), MEAN_OF_THREE,
        )
    ),
    "forecast_few_rounds": f"""{TREES} SELECT {SHOWN}, total_sales AS actual, ROUND(prediction, {MONEY}) AS predicted,
 ROUND({ERROR}, {MONEY}) AS residual FROM z JOIN fitted USING (rid) WHERE is_test AND fit = {WHOLE}""",
    "forecast_few_rounds_quality": QUALITY,
    "forecast_few_rounds_comparison": COMPARED,
    "forecast_few_rounds_summary": f"""SELECT model AS best_model, r2, mae, rmse, cv_r2 FROM ({COMPARED})
 ORDER BY r2 DESC LIMIT 1""",
    "forecast_inside_folds": f"""SELECT * FROM ({inside_folds(LINEAR, INDEPENDENT, 0.0)})
 UNION ALL SELECT * FROM ({inside_folds(RIDGE, FEATURES, ALPHA)})
 UNION ALL SELECT model, cv_r2 FROM ({QUALITY})""",
}
