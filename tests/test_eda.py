import datetime as dt

import numpy as np
import pytest

from checks.written import cleaned
from tests.conftest import SMALL, column
from tillroll.operators import cleaning, eda
from tillroll.plans.exploring import run_eda


@pytest.fixture
def lines(raw):
    return lambda rows: cleaning.add_derived(raw(rows))


def test_histogram_equals_numpy(lines):
    values = [1.0, 2.5, 2.5, 4.0, 9.75, 11.0]
    rows = eda.histogram(lines([{"sales": v} for v in values] + [{"sales": None}]), "sales", 5).collect()
    counts, edges = np.histogram(values, bins=5)
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["bin_start"] for r in rows] == pytest.approx(edges[:-1])
    assert rows[-1]["bin_end"] == pytest.approx(edges[-1])


def test_histogram_of_one_value(lines):
    rows = eda.histogram(lines([{"sales": 3}] * 4), "sales", 60).collect()
    counts, edges = np.histogram([3.0] * 4, bins=60)
    assert [r["count"] for r in rows] == counts.tolist()
    assert rows[0]["bin_start"] == edges[0]


def test_histogram_counts_every_line(spark):
    table = cleaned(spark, SMALL)
    assert sum(column(eda.histogram(table, "sales", 60), "count")) == table.count()


def test_correlation_equals_pandas(lines):
    rows = [
        {"sales": s, "quantity": q, "profit": p, "discount": 0.1}
        for s, q, p in ((1, 5, None), (2, 3, 1), (4, 4, 2), (7, 1, None), (9, 2, 8))
    ]
    df = lines(rows)
    got = {(r["x"], r["y"]): r["corr"] for r in eda.correlation(df).collect()}
    assert len(got) == 21
    want = df.select(*eda.NUMBERS).toPandas().astype(float).corr()
    for (x, y), value in got.items():
        if "discount" in (x, y) or "days_to_ship" in (x, y):
            assert value is None
        else:
            assert value == pytest.approx(want.loc[x, y])


def test_missing_keys_are_left_out(lines):
    df = lines([{"region": "East", "sales": 5}, {"region": None, "sales": 7}])
    assert column(eda.regional(df), "region") == ["East"]
    assert column(eda.subcategory_by_region(df, ["East", "West"]), "total") == [5.0]


def test_ties_go_to_the_first_key(lines):
    df = lines(
        [
            {"region": r, "category": c, "order_date": dt.date(2000, m, 1), "sales": 5}
            for r, c, m in (("B", "Z", 11), ("A", "Y", 2))
        ]
    )
    row = eda.top_performers(df).first()
    assert (row["top_region"], row["top_category"], row["peak_month"]) == ("A", "Y", 2)
    assert (row["top_category_pct"], row["peak_month_name"]) == (50.0, "Feb")


def test_pivot_has_gaps(lines):
    df = lines([{"order_date": dt.date(2000, 1, 1), "sales": 5}, {"order_date": dt.date(2001, 5, 1), "sales": 6}])
    rows = [tuple(r) for r in eda.quarter_by_year(df, [2000, 2001]).collect()]
    assert rows == [(1, 5.0, None), (2, None, 6.0)]


def test_pivots_hold_every_value(lines):
    df = lines(
        [
            {"order_date": dt.date(2000, 1, 1), "region": "East", "sales": 5},
            {"order_date": dt.date(2001, 1, 1), "region": "North", "sales": 100},
        ]
    )
    assert [r.asDict() for r in eda.quarter_by_year(df).collect()] == [
        {"quarter": 1, "sales_2000": 5.0, "sales_2001": 100.0}
    ]
    row = eda.subcategory_by_region(df).first()
    assert (row["east"], row["north"], row["total"]) == (5.0, 100.0, 105.0)
    row = eda.subcategory_by_region(df, ["East"]).first()
    assert (row["east"], row["other"], row["total"]) == (5.0, 100.0, 105.0)


def test_risk_and_peak(lines):
    df = lines(
        [
            {"discount": 0.3, "profit": 100},
            {"discount": 0.31, "profit": -5},
            {"discount": 0.1, "profit": 3},
            {"discount": 0.0, "profit": 2},
        ]
    )
    assert tuple(eda.discount_risk(df).first()) == (-5.0, 2.5)
    assert tuple(eda.q4_peak_check(df).first()) == (2000, 2, False)


def test_shares_add_up(spark):
    table = cleaned(spark, SMALL)
    shares = column(eda.category_share(table), "pct")
    assert sum(shares) == pytest.approx(100, abs=0.05 * len(shares) + 1e-9)
    assert eda.top_share(table).first()["top_pct"] == pytest.approx(sum(shares[:2]))


def test_all_tables(spark):
    tables = run_eda(cleaned(spark, SMALL), [1999, 2000], ["Asia", "Europe"])
    assert len(tables) == 16
    cells = tables["discount_profit"].agg({"lines": "sum"}).first()[0]
    assert cells == cleaned(spark, SMALL).count()
