"""Stored bitmaps of ids against plain distinct counts."""

from __future__ import annotations

import pytest

from checks import catalog
from tests.conftest import SMALL
from tillroll.operators.distinct import count_bitmaps, distinct_bitmaps, merge_bitmaps

IDS = "k string, a long, b string"


def counts(rows, key):
    out = {}
    for r in rows:
        for n, name in ((1, "a"), (2, "b")):
            if r[n] is not None:
                out.setdefault((key(r), name), set()).add(int(r[n]))
    return {at: len(found) for at, found in out.items()}


def test_counts_by_key_and_overall(spark):
    ids = [0, 1, -1, 32768, 32769, 32767, 2**40, 2**40, None, 7]
    rows = [(key, x, None if x is None else str(x // 3)) for key in ("p", "q", None) for x in ids[: 10 if key else 6]]
    maps = distinct_bitmaps(spark.createDataFrame(rows, IDS), ["k"], ["a", "b"])
    got = {(r.k, r.counted): r.n for r in count_bitmaps(maps, ["k"]).collect()}
    assert got == counts(rows, lambda r: r[0])
    overall = {(None, r.counted): r.n for r in count_bitmaps(maps, []).collect()}
    assert overall == counts(rows, lambda r: None)


def test_a_later_table_is_merged(spark):
    one, two = ([("p", x, str(x)) for x in range(*ends)] for ends in ((1, 50_001), (40_001, 70_001)))
    first, later = (distinct_bitmaps(spark.createDataFrame(rows, IDS), ["k"], ["a"]) for rows in (one, two))
    merged = merge_bitmaps(first.unionByName(later), ["k"])
    assert merged.count() == 3  # buckets: 1 to 32,768 and so on
    assert [r.n for r in count_bitmaps(merged, ["k"]).collect()] == [70_000]


def test_no_rows_and_ids_that_are_no_numbers(spark):
    assert count_bitmaps(distinct_bitmaps(spark.createDataFrame([], IDS), ["k"], ["a", "b"]), ["k"]).count() == 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        distinct_bitmaps(spark.createDataFrame([("p", 1, "x7")], IDS), ["k"], ["b"]).collect()


def test_ids_are_not_shuffled(spark):
    maps = distinct_bitmaps(spark.createDataFrame([("p", 1, "2")], IDS), ["k"], ["a", "b"])
    text = maps._jdf.queryExecution().executedPlan().toString()
    exchange = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchange) == 1 and "id#" not in exchange[0].split("ENSURE")[0].replace("_one", "")


def test_query_agrees_with_the_reports(spark):
    got = {(r.region, r.counted): r.n for r in catalog.QUERIES["distinct_from_bitmaps"](spark, SMALL).collect()}
    regions = {r.region: r.unique_customers for r in catalog.QUERIES["region_performance"](spark, SMALL).collect()}
    assert {r: got[r, "customer_id"] for r in regions} == regions
    total = catalog.QUERIES["kpi_overall"](spark, SMALL).first()
    assert (got["all", "order_id"], got["all", "customer_id"]) == (total.total_orders, total.total_customers)


def test_bitmaps_sort_one_number_for_column_and_bucket(spark):
    """Names of columns would make every sorted row longer; ids below zero keep their buckets."""
    data = [("p", -1, "32769"), ("p", -40_000, "1"), (None, 32_768, None), ("p", -1, "32769")]
    maps = distinct_bitmaps(spark.createDataFrame(data, IDS), ["k"], ["a", "b"])
    text = maps._jdf.queryExecution().executedPlan().toString()
    assert "counted" not in text[text.index("Exchange") :]
    got = {(r.k, r.counted, r.bucket) for r in maps.collect()}
    bucket = spark.sql("select bitmap_bucket_number(-1), bitmap_bucket_number(-40000)").first()
    assert got == {("p", "a", bucket[0]), ("p", "a", bucket[1]), (None, "a", 1), ("p", "b", 1), ("p", "b", 2)}
