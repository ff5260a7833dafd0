"""What the plans must and must not contain."""

import re

import pytest

from bench import SLOW
from checks import catalog
from checks.written import cleaned
from tests.conftest import SMALL
from tillroll.functions.dates import in_years
from tillroll.operators import reports, statistics
from tillroll.sources.star import sales_table
from tillroll.staging import stage, staging_root

QUERIES = {k: q for k, q in catalog.QUERIES.items() if k not in SLOW | {"forecast_gbt"}}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_python_and_no_cross_joins(spark, key):
    text = plan(QUERIES[key](spark, SMALL))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "RDDScan"):
        assert node not in text


def _below_single_partitions(text):
    """The operator right under each single-partition exchange."""
    lines = text.splitlines()
    for number, line in enumerate(lines):
        if "SinglePartition" in line:
            below = next(x for x in lines[number + 1 :] if re.search(r"[A-Z]\w+", x))
            yield re.search(r"([A-Z]\w+)", below).group(1)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_single_partitions_hold_aggregates_only(spark, key):
    """Nothing gathers unaggregated rows of a table in one task."""
    allowed = {"HashAggregate", "ObjectHashAggregate", "SortAggregate", "Project"}
    text = plan(QUERIES[key](spark, SMALL))
    assert set(_below_single_partitions(text)) <= allowed
    for match in re.finditer(r"SinglePartition.*\n.*Project.*\n(.*)", text):
        assert "Aggregate" in match.group(1)


def test_year_filter_and_columns_reach_the_scan(spark):
    text = plan(reports.category_yoy(sales_table(spark, SMALL), 2000, 1999))
    assert re.search(r"PushedFilters: \[.*o_orderdate", text)
    assert "c_mktsegment" not in text and "p_brand" not in text


def test_year_folders_are_skipped(spark):
    text = plan(cleaned(spark, SMALL).where("year = 2000").select("sales"))
    assert re.search(r"PartitionFilters: \[.*year.*2000", text)
    assert "ReadSchema: struct<sales:double>" in text


def test_ranking_all_customers_has_no_global_sort(spark):
    text = plan(reports.customer_value_ranks(sales_table(spark, SMALL)))
    assert "hashpartitioning(_part" in text


def test_value_counts_combine_before_the_shuffle(spark):
    lines = cleaned(spark, SMALL).selectExpr("region as target", "sales as value")
    text = plan(statistics.value_counts(lines))
    assert text.index("Exchange hashpartitioning") < text.index("partial_count")


def test_stage_uses_the_checkpoint_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert staging_root(spark) == root if root else True
    assert staging_root(spark).removeprefix("file:") in stage(spark.range(3), "x").inputFiles()[0]


def test_one_folder_for_a_local_application_without_a_setting():
    from types import SimpleNamespace as Space

    made = []
    context = Space(
        master="local[2]", applicationId="app-local", setCheckpointDir=made.append,
        getCheckpointDir=lambda: f"{made[0]}/made-by-spark" if made else None,
    )
    session = Space(sparkContext=context, conf=Space(get=lambda name, default: default))
    assert staging_root(session) == staging_root(session) == made[0]


def test_dropping_staged_tables(tmp_path):
    """Only the application's own folder goes."""
    from types import SimpleNamespace as Space
    from pyspark.sql import SparkSession
    from tillroll.staging import drop_staged

    spark = SparkSession.getActiveSession()
    mine, other = tmp_path / "app-1", tmp_path / "app-2"
    mine.mkdir(), other.mkdir()
    context = Space(
        master="local[1]", applicationId="app-1", _jsc=spark.sparkContext._jsc,
        getCheckpointDir=lambda: str(tmp_path),
    )
    conf = Space(get=lambda name, default: str(tmp_path))
    drop_staged(Space(sparkContext=context, conf=conf, _jvm=spark._jvm))
    assert not mine.exists() and other.exists()


@pytest.mark.parametrize("address", ["spark://host:7077", "local-cluster[2,1,1024]"])
def test_stage_refuses_a_cluster_without_a_shared_folder(address):
    class Context:
        master, applicationId = address, "app-without-folder"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging_root(Session())


def test_cards_read_the_lines_once(spark):
    text = plan(catalog.QUERIES["kpi_cards"](spark, SMALL))
    assert len(re.findall(r"FileScan parquet.*l_extendedprice", text)) == 1
