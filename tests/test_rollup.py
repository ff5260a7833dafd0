"""The dashboard from a stored rollup, estimates from stored sketches, and the bucketed join."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest

from checks import catalog
from tests.conftest import SMALL
from tests.test_plans import plan
from tillroll.operators import dashboard, rollup, sketches
from tillroll.sources import layout
from tillroll.sources.layout import sales_of_layout, write_layout
from tillroll.sources.star import sales_table


def rows(df):
    return sorted(map(str, df.collect()))


LINES = [
    {"order_id": "1", "customer_id": "7", "order_date": dt.date(1999, 12, 31), "sales": "10.05", "profit": "-3"},
    {"order_id": "1", "customer_id": "7", "order_date": dt.date(1999, 12, 31), "sales": "10.05", "profit": "-3"},
    {"order_id": "2", "customer_id": "7", "order_date": dt.date(2000, 1, 1), "region": None, "sales": None},
    {"order_id": "3", "customer_id": "8", "order_date": dt.date(2000, 1, 9), "category": None, "quantity": None},
    {"order_id": "40000", "customer_id": None, "order_date": dt.date(2000, 2, 1), "segment": None, "profit": None},
    {"order_id": "5", "customer_id": "8", "order_date": None},
]


def assert_as_lines(lines, days, ids):
    assert rows(rollup.kpi_cards(days, ids)) == rows(dashboard.kpi_cards(lines))
    assert rows(rollup.drill_through(days)) == rows(dashboard.drill_through(lines))
    assert rows(rollup.monthly_year_compare(days, 2000, 1999)) == rows(dashboard.monthly_year_compare(lines, 2000, 1999))


def test_rollup_answers_as_the_lines_do(spark, sales, tmp_path):
    lines = sales(LINES)
    rollup.write_rollup(lines, str(tmp_path))
    days, ids = rollup.read_rollup(spark, str(tmp_path))
    assert days.count() == len(LINES) - 1
    assert_as_lines(lines, days, ids)


def test_rollup_of_an_empty_table(spark, sales):
    lines = sales([])
    assert_as_lines(lines, rollup.day_rollup(lines), rollup.year_bitmaps(lines))


def test_new_lines_are_merged(sales):
    old, new, both = sales(LINES[:3]), sales(LINES[1:]), sales(LINES[:3] + LINES[1:])
    days = rollup.merge_rollups(rollup.day_rollup(old).unionByName(rollup.day_rollup(new)))
    ids = rollup.merge_year_bitmaps(rollup.year_bitmaps(old).unionByName(rollup.year_bitmaps(new)))
    assert rows(days.select(*rollup.KEYS, "lines")) == rows(rollup.day_rollup(both).select(*rollup.KEYS, "lines"))
    assert_as_lines(both, days, ids)


def test_a_year_is_replaced_and_others_stay(spark, sales, tmp_path):
    rollup.write_rollup(sales(LINES), str(tmp_path))
    files = lambda year: sorted(os.listdir(tmp_path / "days" / f"year={year}"))
    before, changed = files(1999), files(2000)
    later = [line | {"sales": "5"} for line in LINES[2:5]]
    rollup.write_rollup(sales(later), str(tmp_path), replace="present")
    assert files(1999) == before and files(2000) != changed
    assert_as_lines(sales(LINES[:2] + later + LINES[5:]), *rollup.read_rollup(spark, str(tmp_path)))


def test_rollup_plans_read_no_lines(spark, tmp_path):
    rollup.write_rollup(sales_table(spark, SMALL), str(tmp_path))
    days, ids = rollup.read_rollup(spark, str(tmp_path))
    for df in (rollup.kpi_cards(days, ids), rollup.drill_through(days), rollup.monthly_year_compare(days, 2000, 1999)):
        assert "lineitem" not in plan(df)
    compare = plan(rollup.monthly_year_compare(days, 2000, 1999))
    assert "PartitionFilters: [year" in compare and "segment" not in compare


def test_sketches_keep_their_bounds(spark):
    rng = random.Random(5)
    data = [(m, r, rng.randrange(30_000), rng.gauss(0, 1)) for m in range(6) for r in "ab" for _ in range(10_000)]
    df = spark.createDataFrame(data, "m int, r string, i int, v double")
    found = sketches.estimates(sketches.sketch(df, ["m", "r"], ["i"], ["v"]), ["r"], (0.1, 0.5, 0.99)).collect()
    assert {f.r for f in found} == {"a", "b"}
    for f in found:
        own = [x for x in data if x[1] == f.r]
        count = len({x[2] for x in own})
        assert abs(f.distinct_i / count - 1) <= 1.5 * sketches.distinct_error()
        for q, value in zip((0.1, 0.5, 0.99), f.quantiles_v):
            assert abs(sum(x[3] <= value for x in own) / len(own) - q) <= 2 * sketches.rank_error()


def test_a_month_added_is_a_row_added(spark):
    make = lambda m: spark.createDataFrame([(m, i, float(i)) for i in range(m, m + 100)], "m int, i int, v double")
    one, two = (sketches.sketch(make(m), ["m"], ["i"], ["v"]) for m in (0, 50))
    stored = one.unionByName(two)
    assert stored.count() == 2
    assert [tuple(r) for r in sketches.estimates(stored, []).collect()] == [(150, [pytest.approx(74.5, abs=1)])]


def test_sketches_of_nulls_and_of_nothing(spark):
    df = spark.createDataFrame([("a", None, None), (None, 3, 1.5)], "k string, i long, v double")
    stored = sketches.sketch(df, ["k"], ["i"], ["v"])
    assert {r.k: (r.distinct_i, r.quantiles_v) for r in sketches.estimates(stored, ["k"]).collect()} == {
        "a": (0, None), None: (1, [1.5]),
    }
    nothing = sketches.sketch(df.limit(0), ["k"], ["i"], ["v"])
    assert [tuple(r) for r in sketches.estimates(nothing, []).collect()] == [(0, None)]
    assert sketches.estimates(nothing, ["k"]).count() == 0


def test_sketches_keep_no_distinct_ids_in_the_shuffle(spark):
    text = plan(sketches.sketch(sales_table(spark, SMALL), ["region"], ["order_id"], ["sales"]))
    assert "partial_hll_sketch_agg" in text and "partial_kll_sketch_agg_double" in text


def test_bucketed_join_shuffles_nothing(spark, tmp_path):
    write_layout(spark, SMALL, str(tmp_path), buckets=4, prefix="laid_out")
    table = sales_of_layout(spark, "laid_out")
    text = plan(table)
    assert "Exchange" not in text and "SortMergeJoin" in text
    assert len(os.listdir(tmp_path / "lines")) >= 4
    assert rows(table) == rows(sales_table(spark, SMALL))
    few = plan(table.where("order_date >= date'2000-01-01'").select("order_id", "sales"))
    assert "GreaterThanOrEqual(o_orderdate" in few
    assert "c_name" not in few and "p_brand" not in few


def test_bucketed_table_can_be_written_again(spark, tmp_path):
    for _ in range(2):
        write_layout(spark, SMALL, str(tmp_path), buckets=2, prefix="written_again")
    assert sales_of_layout(spark, "written_again").count() == sales_table(spark, SMALL).count()


@pytest.mark.parametrize("key", ["kpi_cards", "kpi_drill", "monthly_year_compare"])
def test_rollup_queries_agree_with_those_on_lines(spark, key):
    on_lines = {"kpi_drill": "kpi_drill_cube"}.get(key, key)
    assert rows(catalog.QUERIES[f"{key}_rollup"](spark, SMALL)) == rows(catalog.QUERIES[on_lines](spark, SMALL))


def test_more_lines_make_more_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "LINES", 500)  # there are 6000
    write_layout(spark, SMALL, str(tmp_path), buckets=4, prefix="many_lines")
    for table in ("lines", "orders"):
        assert "Num Buckets" in str(spark.sql(f"describe extended many_lines_{table}").where("col_name = 'Num Buckets' and data_type = '12'").collect())
    found = sales_of_layout(spark, "many_lines")
    assert "Exchange" not in plan(found) and rows(found) == rows(sales_table(spark, SMALL))
