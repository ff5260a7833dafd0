import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import LINE, SMALL, column
from tillroll.functions.numeric import half_even, half_up
from tillroll.functions.text import strip, title_case
from tillroll.operators import cleaning, quality
from tillroll.operators.reports import kpi_overall
from tillroll.plans.cleaning import clean_sales, run_cleaning
from tillroll.operators.statistics import quantiles
from tillroll.schema import CANONICAL_COLUMNS, EXPECTED_COLUMNS, RENAMES, SALES, UNREADABLE
from tillroll.schema import BROKEN_QUOTES, EXTRA_CELLS, MISSING_CELLS
from tillroll.sources import files, star
from tillroll.sources.star import raw_sales, register_sales, sales_table
from tillroll.staging import staging_path

DAY = dt.date(2000, 1, 10)


@pytest.mark.parametrize(
    "text",
    ["O'Neil", "home-office", "IPHONE 4s", "éCOLE", "ab1c_d2E", "", " two  words ", "3-MEDIUM",
     "中a", "aʼb", "ßa", "ǆx", "İstanbul", "a\nb"],
)
def test_title_case_equals_python(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(title_case(F.col("s")).alias("s")).first()["s"] == text.title()


@pytest.mark.parametrize("text", ["\t a b\n", " x　", "plain", " \r\n", ""])
def test_strip_equals_python(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(strip(F.col("s")).alias("s")).first()["s"] == text.strip()


def test_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    assert column(df.select(half_even(F.col("x")).alias("x")), "x") == [0.0, 2.0, 2.0, 0.0]
    assert column(df.select(half_up(F.col("x"), 0).alias("x")), "x") == [1.0, 2.0, 3.0, -1.0]


def test_dedup_treats_nulls_as_equal(raw):
    df = raw([{"region": None}, {"region": None}, {"region": "East"}])
    assert cleaning.drop_duplicates(df).count() == 2
    assert quality.quality_report(df, "RAW").first()["duplicate_rows"] == 1


def test_a_third_of_all_rows_are_copies(spark):
    """However many copies a row has, it leaves each reading task once."""
    rows = spark.range(30000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as a", "1 as b")
    report = quality.quality_report(rows, "RAW")
    assert (report.first()["rows"], report.first()["duplicate_rows"]) == (30000, 9999)
    distinct = quality.distinct_rows(rows).agg(F.count("a"), F.max(quality.COPIES)).first()
    assert tuple(distinct) == (20001, 10000)
    plan = rows.dropDuplicates()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("HashAggregate")


def test_repeated_orders_ignores_missing_ids(raw):
    df = raw([{"order_id": i, "sales": n} for n, i in enumerate(["a", "a", "b", None, None])])
    assert cleaning.repeated_orders(df).first()[0] == 1


def test_impute(raw):
    df = raw([{"sales": 1, "region": "b"}, {"sales": 4, "region": "a"}, {"sales": None, "region": None}])
    assert sorted(column(cleaning.impute_numeric(df), "sales")) == [1.0, 2.5, 4.0]
    assert sorted(column(cleaning.impute_categorical(df), "region")) == ["a", "a", "b"]


def test_column_without_values_stays_null(raw):
    df = raw([{"sales": None, "region": None}])
    assert column(cleaning.impute_numeric(df), "sales") == [None]
    assert column(cleaning.impute_categorical(df), "region") == [None]
    assert column(cleaning.cap_outliers(df), "sales") == [None]
    assert column(cleaning.numeric_rules(raw([{"quantity": None}])), "quantity") == [None]


def test_sales_filter_keeps_unknown(raw):
    df = raw([{"sales": s} for s in (-1, 0, 0.01, None)])
    assert column(cleaning.drop_nonpositive_sales(df), "sales") == [0.01, None]


def test_date_filter(raw):
    ships = {"same": DAY, "later": dt.date(2000, 1, 11), "earlier": dt.date(2000, 1, 9), "none": None}
    df = raw([{"order_id": k, "order_date": DAY, "ship_date": d} for k, d in ships.items()])
    assert column(cleaning.drop_inverted_dates(df), "order_id") == ["same", "later", "none"]
    assert "none" not in column(cleaning.drop_null_dates(df), "order_id")


def test_numeric_rules(raw):
    df = raw([{"quantity": q, "discount": d} for q, d in ((-1, -0.5), (2.5, 1.5), (3.5, None))])
    out = cleaning.numeric_rules(df)
    assert column(out, "quantity") == [1, 2, 4]
    assert column(out, "discount") == [0.0, 1.0, None]


def test_outliers_are_capped_not_dropped(raw):
    df = raw([{"sales": s} for s in (1, 2, 3, 4, 5, 1000, None)])
    # quartiles 2.25 and 4.75, range 2.5
    assert column(cleaning.cap_outliers(df), "sales") == [1, 2, 3, 4, 5, 12.25, None]


def test_standardise(raw):
    df = raw([{"segment": "  home office\t", "order_id": "ab-1c", "region": None, "state": "NEW york"}])
    row = cleaning.standardise(df).first()
    assert (row["segment"], row["order_id"], row["region"], row["state"]) == (
        "Home Office", "Ab-1C", None, "New York",
    )
    assert cleaning.standardise(df, ["state"]).first()["order_id"] == "ab-1c"
    mapped = cleaning.standardise(df, value_maps={"segment": {"Home Office": "Office"}})
    assert mapped.first()["segment"] == "Office"


def test_derived(raw):
    df = raw([{"order_date": dt.date(2000, 12, 31), "ship_date": dt.date(2001, 1, 2), "sales": 0}])
    row = cleaning.add_derived(df).first()
    assert (row["year"], row["month"], row["quarter"]) == (2000, 12, 4)
    assert (row["day_of_week"], row["days_to_ship"]) == ("Sunday", 2)
    assert row["profit_margin_pct"] is None and row["revenue_per_unit"] == 0


def test_cleaned_table_obeys_the_rules(spark):
    cleaned = clean_sales(raw_sales(spark, SMALL))
    broken = cleaned.agg(
        F.expr("count_if(sales <= 0 or sales is null)").alias("sales"),
        F.expr("count_if(discount not between 0 and 1)").alias("discount"),
        F.expr("count_if(quantity < 1 or quantity is null)").alias("quantity"),
        F.expr("count_if(ship_date < order_date)").alias("dates"),
        F.expr("count_if(region is null or segment is null or customer_name is null)").alias("nulls"),
    ).first()
    assert set(broken) == {0}
    again = cleaning.numeric_rules(cleaning.standardise(cleaned.select(*CANONICAL_COLUMNS)))
    assert again.exceptAll(cleaned.select(*CANONICAL_COLUMNS)).count() == 0


def test_summary_gain(spark, raw):
    before = quality.quality_report(raw([{"region": None}, {"sales": None}, {}]), "RAW")
    after = quality.quality_report(raw([{"region": None}]), "CLEANED", duplicates=False)
    row = quality.quality_summary(before, after).first()
    assert (row["rows_removed"], row["missing_before"], row["accuracy_gain"]) == (2, 2, 50.0)
    missing = quality.missing_by_column(before).where("missing > 0").collect()
    assert {(r["column"], r["missing"]) for r in missing} == {("region", 1), ("sales", 1)}


def _write_raw(tmp_path, lines, header=EXPECTED_COLUMNS):
    path = tmp_path / "raw.csv"
    path.write_text("\n".join([",".join(header), *lines]) + "\n")
    return str(path)


CSV = [
    'A-1,11/8/2000,2000-11-11,First,C1,"O""Neil, Ann",consumer , East,S1,Chairs,Low,P1,10.5,2,0.1,1',
    'A-2,2000-02-30,2000-11-11,First,C1,Ann,N/A,East,S1,Chairs,Low,P1,abc,2,,NaN',
]


def test_raw_file(spark, tmp_path):
    first, second = files.read_raw(spark, _write_raw(tmp_path, CSV), unreadable="mark").collect()
    assert first["Order Date"] == dt.date(2000, 11, 8) and first["Ship Date"] == dt.date(2000, 11, 11)
    assert first["Customer Name"] == 'O"Neil, Ann' and first["Sales"] == 10.5
    assert second["Order Date"] is None and second["Segment"] is None
    assert (second["Sales"], second["Discount"], second["Profit"]) == (None, None, None)
    assert first[UNREADABLE] == [] and second[UNREADABLE] == ["order_date", "sales"]


@pytest.mark.parametrize("cell", ["2000-02-30", "abc"])
def test_an_unreadable_cell_stops_the_job_that_reads_it(spark, tmp_path, cell):
    at = {"2000-02-30": 1, "abc": 12}[cell]
    cells = ["A-1", "2000-11-08", "2000-11-11", "First", "C1", "Ann", "s", "E", "S1", "C", "L", "P", "1.5", "2", "0", "1"]
    cells[at] = cell
    raw = files.read_raw(spark, _write_raw(tmp_path, [",".join(cells)]))
    assert raw.select("Order ID").first()[0] == "A-1"
    with pytest.raises(Exception, match=f"unreadable .*: {cell}"):
        raw.collect()
    with pytest.raises(ValueError, match="unreadable"):
        files.read_raw(spark, str(tmp_path / "raw.csv"), unreadable="maybe")


DIRTY = [
    f"A-{n},{day},2019-11-20,First,C1,Ann,Consumer,East,S1,Chairs,Low,P1,{sales},2,0.1,1"
    for n, (day, sales) in enumerate(
        [("2019-11-08", "10"), ("11/8/2019 10:00", "11"), ("11/8/2019", "12"), ("08-Nov-2019", "13"),
         ("2019-11-09", '"1,234.50"'), ("2019-11-10", ""), ("8. Nov", "14"), ("2019-11-10", "11")]
    )
]


@pytest.mark.parametrize("how, filled", [("keep", [None]), ("fill", [11.5])])
def test_unreadable_cells_are_counted_and_kept_as_asked(spark, tmp_path, how, filled):
    path = _write_raw(tmp_path, [*DIRTY, DIRTY[3]])
    with pytest.raises(ValueError, match=r"'order_date': 3, 'sales': 1"):
        run_cleaning(spark, path, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    before = _staged(spark)
    run = run_cleaning(spark, path, str(tmp_path / "out"), unreadable=how)
    assert _staged(spark) == before
    counts = {r["column"]: r["cells"] for r in run.unreadable.collect() if r["cells"]}
    assert counts == {"order_date": 3, "sales": 1}
    out = files.read_table(spark, str(tmp_path / "out"))
    assert out.columns.count(UNREADABLE) == 0 and out.count() == 6
    assert [r["sales"] for r in out.where("order_id = 'A-4'").collect()] == filled
    assert out.where("order_id = 'A-5'").first()["sales"] == 11.5
    assert out.where("order_id = 'A-1'").first()["order_date"] == dt.date(2019, 11, 8)
    steps = {(r["step"], r["column"]): r["affected"] for r in run.audit.collect()}
    assert steps["fill_median", "sales"] == (1 if how == "keep" else 2)
    assert steps["drop_duplicates", "*"] == 1 and steps["drop_null_dates", "*"] == 2
    assert run.before.first()["duplicate_rows"] == 1 and run.after.first()["duplicate_rows"] == 0
    assert run.before.first()["columns"] == len(CANONICAL_COLUMNS)


SHAPES = [
    DIRTY[0].replace("2019", "2020") + ",more,cells",
    "B-1,2019-11-08,2019-11-20,First,C1,Ann,Consumer,East,S1,Chairs,Low,P1,20",
    'B-2,2019-11-08,2019-11-20,First,C1,"Ann,Consumer,East,S1,Chairs,Low,P1,30,2,0.1,1',
    'B-3,2019-11-08,2019-11-20,First,C1,"Ann, ""A"" B",Consumer,East,S1,Chairs,Low,P1,40,3e9,0.1,1',
]


@pytest.mark.parametrize("how, quantity", [("keep", None), ("fill", 1_500_000_001)])
def test_lines_of_the_wrong_shape(spark, tmp_path, how, quantity):
    path = _write_raw(tmp_path, SHAPES)
    with pytest.raises(ValueError, match=r"'\(extra cells\)': 1, '\(missing cells\)': 1, '\(broken quotes\)': 1"):
        run_cleaning(spark, path, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    run = run_cleaning(spark, path, str(tmp_path / "out"), unreadable=how)
    counts = {r["column"]: r["cells"] for r in run.unreadable.collect() if r["cells"]}
    numbers = {"sales": 1, "quantity": 2, "discount": 2, "profit": 2}
    assert counts == numbers | {EXTRA_CELLS: 1, MISSING_CELLS: 1, BROKEN_QUOTES: 1}
    out = {r["order_id"]: r for r in files.read_table(spark, str(tmp_path / "out")).collect()}
    assert out["A-0"]["sales"] == 10 and out["B-3"]["customer_name"] == 'Ann, "A" B'
    assert out["B-1"]["quantity"] == quantity and out["B-3"]["quantity"] == 3_000_000_000


def test_a_line_of_the_wrong_shape_stops_the_job_that_reads_it(spark, tmp_path):
    raw = files.read_raw(spark, _write_raw(tmp_path, SHAPES[:1]))
    with pytest.raises(Exception, match="line with .extra cells.: A-0"):
        raw.select("Order ID").collect()


@pytest.mark.parametrize(
    "line, fault",
    [("1,2,3,4", EXTRA_CELLS), ("1,2", MISSING_CELLS), ("", MISSING_CELLS), ('1,"2,3', BROKEN_QUOTES),
     ('"a,""b"",c",2', MISSING_CELLS), ('1,"x,y",3,""', EXTRA_CELLS), (None, None)],
)
def test_line_faults(spark, line, fault):
    df = spark.createDataFrame([(line,)], "x string")
    assert df.select(files.line_fault(df["x"], 3)).first()[0] == fault


def _staged(spark):
    return sorted(os.listdir(staging_path(spark, "x").removeprefix("file:").rsplit("/", 1)[0]))


def _year_lines(*days):
    return [f"Y-{n},{day},{day},First,C1,Ann,Consumer,East,S1,Chairs,Low,P1,{10 + n},2,0.1,1" for n, day in enumerate(days)]


def test_some_years_are_replaced(spark, tmp_path):
    out = tmp_path / "out"

    def files_of(year):
        return {p.name: p.stat().st_mtime_ns for p in (out / f"year={year}").glob("part-*")}

    days = ["2018-05-01", "2019-05-01", "2020-05-01"]
    run_cleaning(spark, _write_raw(tmp_path, _year_lines(*days)), str(out))
    old, gone = files_of(2020), files_of(2019)
    assert old and gone and (out / "year=2018").exists()
    path = _write_raw(tmp_path, _year_lines("2020-06-01", "2019-05-01", "2020-05-01", "2019-07-01"))
    with pytest.raises(ValueError, match="Parquet"):
        run_cleaning(spark, path, str(out), "csv", years=[2019])
    run = run_cleaning(spark, path, str(out), years=[2018, 2019])
    assert files_of(2020) == old and not set(files_of(2019)) & set(gone) and not (out / "year=2018").exists()
    rows = files.read_table(spark, str(out)).select("order_id", "year").collect()
    assert sorted(map(tuple, rows)) == [("Y-1", 2019), ("Y-2", 2020), ("Y-3", 2019)]
    assert run.after.first()["rows"] == 3


def test_a_failed_replacement_leaves_the_old_years(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_table(spark.range(3).selectExpr("id", "2019 + cast(id as int) as year"), path)
    bad = spark.range(9).selectExpr("if(id = 8, cast(raise_error('no') as bigint), id) as id", "2019 + cast(id % 2 as int) as year")
    with pytest.raises(Exception, match="no"):
        files.write_table(bad, path, replace="present")
    assert sorted(map(tuple, files.read_table(spark, path).collect())) == [(0, 2019), (1, 2020), (2, 2021)]
    with pytest.raises(ValueError, match="replace"):
        files.write_table(bad, path, format="csv", replace="present")


def test_infinities_are_no_values(spark):
    df = spark.createDataFrame([(-math.inf,), (-math.inf,), (1.0,), (3.0,), (math.inf,), (math.nan,), (None,)], "x double")
    assert quantiles(df, {"x": [0.5]}) == {("x", 0.5): 2.0}


def test_missing_columns_are_named_and_extra_ones_kept(spark, tmp_path):
    with pytest.raises(ValueError, match="Sales"):
        files.read_raw(spark, _write_raw(tmp_path, [], [c for c in EXPECTED_COLUMNS if c != "Sales"]))
    wide = files.read_raw(spark, _write_raw(tmp_path, [CSV[0] + ",x"], EXPECTED_COLUMNS + ["Note"]))
    assert wide.first()["Note"] == "x"
    assert cleaning.rename_columns(wide).columns == CANONICAL_COLUMNS + ["Note"]


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_from_file_to_file(spark, tmp_path, format):
    header = spark.createDataFrame([tuple(LINE.values())], list(LINE)).columns
    raw = raw_sales(spark, SMALL).withColumnsRenamed({v: k for k, v in RENAMES.items()})
    assert len(header) == len(raw.columns)
    raw.write.option("header", True).option("escape", '"').csv(str(tmp_path / "raw"))
    run = run_cleaning(spark, str(tmp_path / "raw"), str(tmp_path / "out"), format)
    summary = run.summary
    cleaned = files.read_table(spark, str(tmp_path / "out"), format)
    direct = clean_sales(raw_sales(spark, SMALL))
    shown = [c for c in direct.columns]
    assert cleaned.select(*shown).exceptAll(direct).count() == 0
    same = quality.cleaning_audit(raw_sales(spark, SMALL))
    assert sorted(run.audit.collect()) == sorted(same.collect())
    assert summary.first()["rows_after"] == cleaned.count() == direct.count()


def test_sales_view(spark):
    sales = sales_table(spark, SMALL)
    register_sales(sales)
    assert spark.sql("select count(*) from sales").first()[0] == sales.count()


def test_reports_on_cleaned_lines(spark):
    cleaned = clean_sales(raw_sales(spark, SMALL))
    sales = files.reporting_table(cleaned)
    assert sales.schema.simpleString() == SALES.simpleString()
    got = kpi_overall(sales).first()
    assert got["total_revenue"] == pytest.approx(cleaned.agg(F.sum("sales")).first()[0], abs=1)


def test_grouping_raw_lines_needs_no_shuffle_of_whole_rows(spark, monkeypatch):
    """Joined lines lie where equal rows meet, also where the parts are sized by the lines."""
    monkeypatch.setattr(star, "LINES", 500)
    for many in (star.MANY, 1000):
        monkeypatch.setattr(star, "MANY", many)
        raw = raw_sales(spark, SMALL)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = cleaning.drop_duplicates(raw)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
    assert "hashpartitioning(order_id#" in plan and ", 12)" in plan


def test_each_task_writes_its_own_rows_by_year(spark, tmp_path):
    df = spark.range(0, 40, 1, 2).selectExpr("id", "2019 + cast(id % 2 as int) as year")
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    files.write_table(df, str(tmp_path / "own"), even=False)
    assert spark.conf.get(name) == before
    assert len(list((tmp_path / "own").glob("year=*/part-*"))) == 4  # two tasks, two years
    assert sorted(map(tuple, files.read_table(spark, str(tmp_path / "own")).collect())) == sorted(map(tuple, df.collect()))


def test_copies_are_counted_by_hash_as_by_row(spark):
    rows = [("a", None, 1.0), (None, "a", 1.0), ("a", None, 1.0), ("a", "b", float("nan")), ("a", "b", float("nan")),
            ("z", "z", 0.0), ("z", "z", -0.0), (None, None, None), (None, None, None), (None, None, None), ("u", "v", 2.0)]
    df = spark.createDataFrame(rows, "x string, y string, n double")
    by_row, by_hash = (quality.quality_report(df, "T", stored=s).first() for s in (False, True))
    assert by_hash == by_row and by_row["duplicate_rows"] == 5
    assert quality.quality_report(df.limit(0), "T", stored=True).first() == quality.quality_report(df.limit(0), "T").first()
