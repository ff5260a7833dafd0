import datetime as dt

import pytest

from tests.conftest import column
from tillroll.operators import dashboard, reports


def test_discount_bucket_edges(sales):
    cases = {
        "-0.1": "30%+", "0": "No Discount", "0.05": "1-10%", "0.1": "1-10%", "0.15": "11-20%",
        "0.2": "11-20%", "0.25": "21-30%", "0.3": "21-30%", "0.35": "30%+", None: "30%+",
    }
    df = sales([{"discount": d, "order_id": str(d)} for d in cases])
    got = df.select("order_id", reports.discount_bucket(df.discount).alias("b")).collect()
    assert {r["order_id"]: r["b"] for r in got} == {str(d): b for d, b in cases.items()}


def test_margin_is_null_without_sales(sales):
    df = sales([{"sales": 0, "profit": 5}])
    assert reports.kpi_overall(df).first()["profit_margin_pct"] is None
    assert column(reports.region_performance(df), "profit_margin_pct") == [None]


def test_kpis(sales):
    df = sales(
        [
            {"order_id": "1", "sales": "10.00", "profit": "1.25", "quantity": 2},
            {"order_id": "1", "sales": "20.00", "profit": "-3.00", "quantity": 3},
            {"order_id": "2", "customer_id": "c2", "sales": "5.55", "profit": "0"},
        ]
    )
    assert reports.kpi_overall(df).first().asDict() == {
        "total_orders": 2, "total_customers": 2, "total_revenue": 35.55, "total_profit": -1.75,
        "total_units_sold": 6, "profit_margin_pct": -4.92,
    }


def test_growth_follows_rows_and_survives_zero(sales):
    df = sales(
        [
            {"order_date": dt.date(2000, 1, 5), "sales": 0},
            {"order_date": dt.date(2000, 2, 5), "sales": 50},
            {"order_date": dt.date(2000, 5, 5), "sales": 75},
        ]
    )
    rows = reports.monthly_growth(df).collect()
    assert [r["prev_month_sales"] for r in rows] == [None, 0.0, 50.0]
    assert [r["mom_growth_pct"] for r in rows] == [None, None, 50.0]


def test_equal_regions_share_a_rank_and_null_is_kept(sales):
    df = sales(
        [{"region": r, "sales": s} for r, s in (("A", 5), ("B", 5), ("C", 3), (None, 9))]
    )
    got = {r["region"]: r["revenue_rank"] for r in reports.region_performance(df).collect()}
    assert got == {None: 1, "A": 2, "B": 2, "C": 4}


def test_top_states_ranks_match_the_whole(sales):
    df = sales([{"state": f"S{i}", "sales": 100 - i // 3} for i in range(15)])
    top = reports.top_states(df, k=10).collect()
    assert [r["state_rank"] for r in top] == [1, 1, 1, 4, 4, 4, 7, 7, 7, 10]
    assert [r["state"] for r in top][:3] == ["S0", "S1", "S2"]


def test_yoy_needs_both_years(sales):
    df = sales(
        [
            {"category": "both", "order_date": dt.date(2000, 12, 31), "sales": 30},
            {"category": "both", "order_date": dt.date(1999, 1, 1), "sales": 20},
            {"category": "new", "order_date": dt.date(2000, 1, 1), "sales": 30},
            {"category": "old", "order_date": dt.date(1999, 1, 1), "sales": 30},
            {"category": "zero", "order_date": dt.date(2000, 1, 1), "sales": 30},
            {"category": "zero", "order_date": dt.date(1999, 1, 1), "sales": 0},
            {"category": "both", "order_date": dt.date(2001, 1, 1), "sales": 999},
        ]
    )
    rows = {r["category"]: r for r in reports.category_yoy(df, 2000, 1999).collect()}
    assert set(rows) == {"both", "zero"}
    assert (rows["both"]["yoy_change"], rows["both"]["yoy_growth_pct"]) == (10.0, 50.0)
    assert rows["zero"]["yoy_growth_pct"] is None


@pytest.mark.parametrize("n, tiles", [(2, [1, 2]), (5, [1, 1, 2, 3, 4]), (7, [1, 1, 2, 2, 3, 3, 4])])
def test_customer_quartiles(sales, n, tiles):
    df = sales([{"customer_id": f"c{i}", "sales": 100 - i} for i in range(n)])
    for report in (reports.customer_ltv, reports.customer_value_ranks):
        rows = sorted(report(df).collect(), key=lambda r: r["customer_id"])
        assert [r["value_quartile"] for r in rows] == tiles
        assert [r["value_rank"] for r in rows] == list(range(1, n + 1))


def test_equal_customers_share_a_rank(sales):
    df = sales([{"customer_id": f"c{i}", "sales": s} for i, s in enumerate((9, 9, 5))])
    assert column(reports.customer_ltv(df), "value_rank") == [1, 1, 3]


def test_sketched_distinct_counts_are_close(sales):
    df = sales([{"order_id": str(i)} for i in range(500)])
    assert abs(reports.kpi_overall(df, rsd=0.02).first()["total_orders"] - 500) < 50


def test_drill_through_levels_add_up(sales):
    df = sales([{"region": r, "segment": g, "sales": 10} for r in "AB" for g in "XYZ"])
    rows = dashboard.drill_through(df).collect()
    sums = {}
    for r in rows:
        sums[r["level"]] = sums.get(r["level"], 0) + r["total_sales"]
    assert sums == dict.fromkeys(("total", "region", "category", "segment"), 60.0)


def test_cards(sales):
    df = sales(
        [
            {"order_date": dt.date(2000, 1, 5), "sales": 50},
            {"order_date": dt.date(2000, 2, 5), "sales": 75, "region": "West"},
        ]
    )
    cards = {r["kpi"]: r["value"] for r in dashboard.kpi_cards(df).collect()}
    assert cards["latest_month_sales"] == 75 and cards["latest_mom_growth_pct"] == 50
    assert cards["region_sales: East"] == 50 and cards["region_sales: West"] == 75
    assert len(cards) == 10


def test_a_customer_with_a_third_of_all_lines(spark, sales):
    lines = [
        {"customer_id": "hot" if i % 3 == 0 else f"c{i % 50}", "order_id": str(i // 2), "sales": i % 7}
        for i in range(3000)
    ]
    got = {r["customer_id"]: r for r in reports.customer_value_ranks(sales(lines)).collect()}
    totals, orders = {}, {}
    for x in lines:
        totals[x["customer_id"]] = totals.get(x["customer_id"], 0) + x["sales"]
        orders.setdefault(x["customer_id"], set()).add(x["order_id"])
    assert {c: r["lifetime_value"] for c, r in got.items()} == totals
    assert {c: r["total_orders"] for c, r in got.items()} == {c: len(o) for c, o in orders.items()}
    ranks = {c: 1 + sum(v > totals[c] for v in totals.values()) for c in totals}
    assert {c: r["value_rank"] for c, r in got.items()} == ranks


def test_cards_expand_lines_into_ids_once(spark, sales):
    """Orders and customers are counted once for the whole, not for every month and region."""
    lines = [{}, {"order_id": "2", "customer_id": None}, {"order_id": None}, {"region": None, "order_date": None}]
    cards = dashboard.kpi_cards(sales(lines))
    assert cards._jdf.queryExecution().executedPlan().toString().count("Expand [") == 1  # for the whole, months, regions
    got = {r["kpi"]: r["value"] for r in cards.collect()}
    assert (got["total_orders"], got["total_customers"], got["total_revenue"]) == (2, 1, 40)
    assert got["latest_month_sales"] == 30 and got["region_sales: East"] == 30
