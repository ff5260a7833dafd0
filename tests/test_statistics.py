import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillroll.operators.ranking import rank_all
from tillroll.operators.statistics import _brackets, _walk, modes, quantiles


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-50, 50).map(lambda x: x / 4), min_size=1, max_size=300))
def test_quantiles_equal_linear_interpolation(spark, values):
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantiles(df, {"x": probabilities})
    for q in probabilities:
        assert got["x", q] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_quantiles_of_several_columns_with_a_hot_value(spark):
    x = [7.0] * 4000 + [float(i) for i in range(3000)] + [None, float("nan")]
    y = [float(i * i % 997) for i in range(len(x))]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    assert quantiles(df, {"x": [0.5], "y": [0.25, 0.5]}) == {
        ("x", 0.5): np.quantile(x[:7000], 0.5),
        ("y", 0.25): np.quantile(y, 0.25),
        ("y", 0.5): np.quantile(y, 0.5),
    }


def test_column_without_values_has_no_quantile_or_mode(spark):
    df = spark.createDataFrame([(None, None)], "x double, s string")
    assert quantiles(df, {"x": [0.5]}) == {}
    assert modes(df, ["s"]) == {}


def test_sketch(spark):
    df = spark.range(1001).selectExpr("cast(id as double) as x")
    assert abs(quantiles(df, {"x": [0.5]}, accuracy=10000)["x", 0.5] - 500) <= 1


@pytest.mark.parametrize("shape", ["mixed", "sorted", "hot"])
def test_brackets_hold_the_quantiles(spark, shape):
    """Whether the parts of the table look alike or not, and with a third of it on one value."""
    n = 60000
    x = np.random.default_rng(7).lognormal(10, 2, n).round(2)
    if shape == "sorted":
        x.sort()
    if shape == "hot":
        x[::3] = np.quantile(x, 0.4)
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartitionByRange(6, "x") if (
        shape == "sorted"
    ) else spark.createDataFrame(pd.DataFrame({"x": x})).repartition(6)
    wanted = {"x": [0.25, 0.5, 0.75, 0.999]}
    totals, brackets = _brackets(df, wanted)
    assert totals == {"x": n}
    found = _walk(df, totals, brackets)
    assert set(found) == set(brackets)
    for (_, q), value in found.items():
        assert value == pytest.approx(np.quantile(x, q), rel=1e-12)
    if shape == "mixed":
        low, high = brackets["x", 0.5]
        assert ((x >= low) & (x <= high)).sum() < n / 10


def test_missed_brackets_are_opened(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    assert _walk(df, {"x": 10}, {("x", 0.5): (4.0, 4.0)}) == {}
    assert _walk(df, {"x": 10}, {("x", 0.5): (6.0, 9.0)}) == {}
    assert quantiles(df, {"x": [0.5]}) == {("x", 0.5): 4.5}


def test_mode_is_the_smallest_of_the_most_frequent(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,), (None,), (None,)], "s string")
    assert modes(df, ["s"]) == {"s": "a"}


@pytest.mark.parametrize("distinct", [1, 3, 40, 5000])
def test_ranks_across_partitions(spark, distinct):
    """Ties longer than a partition rank as one."""
    n, buckets = 2003, 4
    data = pd.DataFrame({"id": range(n), "v": [float(i * 7919 % distinct) for i in range(n)]})
    got = rank_all(spark.createDataFrame(data), "v", ["id"], buckets, "r", "t").toPandas()
    got = got.sort_values("id").reset_index(drop=True)
    want_rank = data["v"].rank(method="min", ascending=False).astype(int)
    assert (got["r"] == want_rank).all()
    order = data.sort_values(["v", "id"], ascending=[False, True]).index
    sizes = [n // buckets + (b < n % buckets) for b in range(buckets)]
    tiles = pd.Series(np.repeat(range(1, buckets + 1), sizes), index=order).sort_index()
    assert (got["t"] == tiles).all()


def test_ranks_put_nulls_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, 9.0)], "id int, v double")
    got = {r["id"]: (r["r"], r["t"]) for r in rank_all(df, "v", ["id"], 2, "r", "t").collect()}
    assert got == {4: (1, 1), 2: (2, 1), 1: (3, 2), 3: (3, 2)}
