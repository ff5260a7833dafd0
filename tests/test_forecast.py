import datetime as dt

import numpy as np
import pytest

from checks.written import cleaned, scaled_matrix
from tests.conftest import SMALL
from tillroll.operators import cleaning, features, forecast
from tillroll.plans.forecasting import run_forecasting

FEW_TREES = forecast.BOOSTING | {"maxIter": 3}


@pytest.fixture(scope="module")
def data(spark):
    return forecast.assemble(scaled_matrix(spark, SMALL)).persist()


def _arrays(data, condition, inputs):
    rows = data.where(condition).select(*inputs, features.TARGET).toPandas()
    return rows[inputs].to_numpy(float), rows[features.TARGET].to_numpy(float)


def _r2(actual, predicted):
    return 1 - ((actual - predicted) ** 2).sum() / ((actual - actual.mean()) ** 2).sum()


def _ridge(x, y, alpha):
    centre = x.mean(axis=0)
    xc = x - centre
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - y.mean()))
    return w, y.mean() - centre @ w


def test_lags_need_three_rows(raw):
    def sold(category, months):
        return [
            {"category": category, "order_date": dt.date(2000, m, 1), "ship_date": dt.date(2000, m, 2), "sales": m}
            for m in months
        ]

    lines = sold("short", (1, 2, 3)) + sold("enough", (1, 2, 3, 4)) + sold("gap", (1, 2, 4, 7))
    lines += [{"category": None, "sales": 5}]
    rows = features.feature_matrix(cleaning.add_derived(raw(lines))).collect()
    got = {
        r["category"]: tuple(r[c] for c in (*features.LAGS, "rolling_3avg", "category_enc"))
        for r in rows
    }
    assert got == {"enough": (3.0, 2.0, 1.0, 2.0, 0), "gap": (4.0, 2.0, 1.0, pytest.approx(7 / 3), 1)}


def test_lags_of_the_calendar(raw):
    """Months without sales count as zero in the lags, and get no rows of their own in the matrix."""
    lines = [
        {"category": c, "order_date": dt.date(y, m, 1), "ship_date": dt.date(y, m, 2), "sales": 100 * y + m - 190000}
        for c, y, m in [("a", 2000, 11), ("a", 2000, 12), ("a", 2001, 3), ("b", 2000, 1), ("b", 2000, 4), ("b", 2000, 5)]
    ]
    monthly = features.monthly_features(cleaning.add_derived(raw(lines)))
    rows = features.add_lags(monthly, densify=True).orderBy("category", "year", "month").collect()
    assert [(r["category"], r["year"], r["month"], r["quarter"]) for r in rows] == [
        ("a", 2000, 11, 4), ("a", 2000, 12, 4), ("a", 2001, 1, 1), ("a", 2001, 2, 1), ("a", 2001, 3, 1),
        ("b", 2000, 1, 1), ("b", 2000, 2, 1), ("b", 2000, 3, 1), ("b", 2000, 4, 2), ("b", 2000, 5, 2),
    ]
    assert [r["total_sales"] for r in rows] == [10011, 10012, 0, 0, 10103, 10001, 0, 0, 10004, 10005]
    assert [r["order_count"] for r in rows] == [1, 1, 0, 0, 1, 1, 0, 0, 1, 1]
    assert [r["lag_3_sales"] for r in rows[3:5]] == [10011, 10012] and rows[2]["avg_discount"] is None
    matrix = features.feature_matrix(cleaning.add_derived(raw(lines)), densify=True)
    assert sorted((r["category"], r["month"], r["lag_1_sales"]) for r in matrix.collect()) == [("a", 3, 0), ("b", 4, 0), ("b", 5, 10004)]
    assert features.add_lags(monthly).count() == 6


def test_scaling(spark, data):
    x, _ = _arrays(data, "not is_test", features.FEATURES)
    scaled, _ = _arrays(data, "not is_test", forecast.SCALED)
    assert scaled == pytest.approx((x - x.mean(axis=0)) / x.std(axis=0))
    flat = scaled_matrix(spark, SMALL).select("month", "is_test").withColumn("month", features.F.lit(3))
    assert features.scale(flat, ["month"]).where("month_sc <> 0").count() == 0


def test_split_is_about_a_fifth(data):
    share = data.where("is_test").count() / data.count()
    assert 0.15 < share < 0.25


def test_linear_predicts_like_least_squares(data):
    x, y = _arrays(data, "not is_test", forecast.SCALED)
    tx, ty = _arrays(data, "is_test", forecast.SCALED)
    w = np.linalg.lstsq(np.c_[np.ones(len(x)), x], y, rcond=None)[0]
    fitted = forecast.fit(forecast.LINEAR, data)
    r2 = forecast.metrics(fitted.predicted).first()["r2"]
    assert r2 == pytest.approx(_r2(ty, np.c_[np.ones(len(tx)), tx] @ w), abs=1e-6)


@pytest.mark.parametrize("alpha", [1.0, 50.0])
def test_ridge_equals_closed_form(data, alpha):
    x, y = _arrays(data, "not is_test", forecast.SCALED)
    w, b = _ridge(x, y, alpha)
    estimator = forecast.RidgeRegression(
        alpha=alpha, featuresCol="scaled", labelCol=features.TARGET
    )
    model = estimator.fit(data.where("not is_test"))
    assert model.coefficients.toArray() == pytest.approx(w, rel=1e-8, abs=1e-6)
    assert model.intercept == pytest.approx(b, rel=1e-8)


def test_folds_of_ridge(data):
    scores = []
    for k in range(forecast.FOLDS):
        w, b = _ridge(*_arrays(data, f"not is_test and fold <> {k}", forecast.SCALED), 1.0)
        x, y = _arrays(data, f"not is_test and fold = {k}", forecast.SCALED)
        scores.append(_r2(y, x @ w + b))
    assert forecast.fit_with_folds(forecast.RIDGE, data).cv_r2 == pytest.approx(np.mean(scores))


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (8.0, 5.0)], f"{features.TARGET} double, prediction double")
    y, p = np.array([1.0, 3.0, 8.0]), np.array([2.0, 3.0, 5.0])
    row = forecast.metrics(df).first()
    assert tuple(row) == pytest.approx((_r2(y, p), np.abs(y - p).mean(), np.sqrt(((y - p) ** 2).mean())))
    assert tuple(forecast.perfect_line(df).first()) == (1.0, 8.0)
    assert forecast.metrics(df.limit(1)).first()["r2"] is None


def test_comparison_picks_the_best(spark):
    models, best = run_forecasting(cleaned(spark, SMALL), FEW_TREES)
    rows = forecast.comparison(models).collect()
    assert [r["model"] for r in rows] == [forecast.LINEAR, forecast.RIDGE, forecast.BOOSTED]
    assert all(r["cv_r2"] is not None for r in rows)
    top = max(rows, key=lambda r: r["r2"])
    summary = forecast.summary(best).first()
    assert summary["best_model"] == top["model"]
    assert [summary[c] for c in ("r2", "mae", "rmse", "cv_r2")] == pytest.approx(
        [top[c] for c in ("r2", "mae", "rmse", "cv_r2")]
    )
    naive = forecast.metrics(
        forecast.naive(scaled_matrix(spark, SMALL)).where("is_test")
    ).first()["r2"]
    assert summary["r2"] > naive


def test_residuals_and_importance(spark, data):
    fitted = forecast.fit(forecast.BOOSTED, data, FEW_TREES)
    off = forecast.residuals(fitted.predicted).where("abs(actual - predicted - residual) > 1e-9")
    assert off.count() == 0
    for model in (fitted, forecast.fit(forecast.RIDGE, data)):
        rows = forecast.importance(model, spark).collect()
        weights = [r["importance"] for r in rows]
        assert len(rows) == 14 and weights == sorted(weights)
        assert [r["is_major"] for r in rows] == [w >= np.median(weights) for w in weights]


def test_bands(spark, data):
    rows = forecast.forecast_bands(scaled_matrix(spark, SMALL)).collect()
    last = data.selectExpr("max(year * 12 + month) as m").first()["m"]
    assert {r["year"] * 12 + r["month"] for r in rows} == {last + 1}
    assert len(rows) == data.select("region", "category").distinct().count()
    widths = {round(r["upper"] - r["forecast"], 4) for r in rows}
    assert len(widths) == 1 and widths.pop() > 0


def test_ended_series_get_no_forecast(spark):
    rows = [
        ("East", "Tables", 1, 1, 2018, 12, 10.0, 9.0, 8.0),
        ("East", "Chairs", 1, 2, 2018, 11, 10.0, 9.0, 8.0),
        ("East", "Chairs", 1, 2, 2018, 12, 11.0, 10.0, 9.0),
        ("West", "Tables", 2, 1, 2018, 10, 7.0, 6.0, 5.0),
    ]
    names = f"region string, category string, region_enc int, category_enc int, year int, month int, {forecast.TARGET} double, lag_1_sales double, lag_2_sales double"
    ahead = forecast.next_month(spark.createDataFrame(rows, names)).collect()
    got = sorted((r.region, r.category, r.year, r.month, r.lag_1_sales, r.lag_3_sales) for r in ahead)
    assert got == [("East", "Chairs", 2019, 1, 11.0, 9.0), ("East", "Tables", 2019, 1, 10.0, 8.0)]


def test_rolling_origin(spark, data):
    """Each origin learns from the months before it only."""
    matrix = scaled_matrix(spark, SMALL).drop(*forecast.SCALED)
    got = forecast.rolling_origin(matrix, [forecast.RIDGE, forecast.NAIVE], origins=2, horizon=3).collect()
    last = max(r["year"] * 12 + r["month"] - 1 for r in matrix.select("year", "month").collect())
    starts = [last - 5, last - 2]
    names = [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in starts]
    assert [(r["model"], r["origin"]) for r in got] == [(m, o) for m in (forecast.RIDGE, forecast.NAIVE) for o in names]
    frame = matrix.toPandas()
    number = frame["year"] * 12 + frame["month"] - 1
    for start, ridge, mean in zip(starts, got[:2], got[2:]):
        old, ahead = frame[number < start], frame[(number >= start) & (number < start + 3)]
        x, y = (old[c].to_numpy(float) for c in (features.FEATURES, features.TARGET))
        sd = x.std(axis=0, ddof=1)
        sd[sd == 0] = 1
        w, b = _ridge((x - x.mean(axis=0)) / sd, y, forecast.ALPHA)
        predicted = (ahead[features.FEATURES].to_numpy(float) - x.mean(axis=0)) / sd @ w + b
        actual = ahead[features.TARGET].to_numpy(float)
        assert ridge["r2"] == pytest.approx(_r2(actual, predicted), rel=1e-6)
        assert ridge["rows"] == mean["rows"] == len(ahead)
        assert mean["mae"] == pytest.approx(abs(actual - ahead["rolling_3avg"].to_numpy(float)).mean())
    assert forecast.rolling_origin(matrix.limit(0), [forecast.RIDGE]).count() == 0


def test_choosing_by_folds(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 2.1), (3.0, 2.9)], f"{features.TARGET} double, prediction double")
    poor = rows.withColumn("prediction", features.F.lit(2.0))
    models = [forecast.Fitted("a", None, poor, 0.9), forecast.Fitted("b", None, rows, 0.5)]
    assert forecast.best_of(models).name == "b" and forecast.best_of(models, "cv").name == "a"
    with pytest.raises(ValueError, match="choose"):
        forecast.best_of(models, "luck")
