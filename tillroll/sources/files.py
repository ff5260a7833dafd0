"""Raw CSV in, cleaned tables out and back in."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.schema import (
    BROKEN_QUOTES, DATES, EXPECTED_COLUMNS, EXTRA_CELLS, LINE, MISSING_CELLS, NUMERIC, RAW, RENAMES, SALES, UNREADABLE,
)
from tillroll.staging import delete, stage

# The texts that stand for a missing value in a raw file.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Date spellings tried after ISO dates, each with or without a time of day.
DATE_FORMATS = ("M/d/yyyy", "M-d-yyyy", "yyyy/M/d")
_TIMES = "[ H:mm[:ss]]"

YEARS_OPEN = 16  # folders a task writes to at a time; an open file holds rows in memory


def check_columns(df: DataFrame, expected: list[str] = EXPECTED_COLUMNS) -> DataFrame:
    """Raise when expected columns are missing; extra ones are fine."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise ValueError(f"Missing expected columns: {missing}")
    return df


def parse_date(x: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """A date from text; null when no format fits."""
    parsed = [F.try_to_timestamp(x, F.lit(f + _TIMES)).cast("date") for f in formats]
    return F.coalesce(x.try_cast("date"), *parsed)


def line_cells(line: Column) -> Column:
    """How many cells the text of a line has: commas outside of quotes part them."""
    return F.size(F.split(F.regexp_replace(line, r'"[^"]*"', ""), ","))


def line_fault(line: Column, cells: int) -> Column:
    """What is wrong with the text of a line of the wrong shape; null for a null line.

    A sound line has an even number of quotes, since those inside a cell are doubled.
    """
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"')))
    return (
        F.when(line.isNull(), None)
        .when(quotes % 2 == 1, BROKEN_QUOTES)
        .when(line_cells(line) > cells, EXTRA_CELLS)
        .otherwise(MISSING_CELLS)
    )


def typed(
    df: DataFrame, date_formats: tuple[str, ...] = DATE_FORMATS, unreadable: str = "raise"
) -> DataFrame:
    """Text columns as numbers and dates where RAW says so; missing texts become null.

    A cell is unreadable if it is not missing and yet no number (infinities count as none) or
    date. ``raise`` ends the job that reads such a cell, with its column and text; ``mark``
    makes it null and adds the column ``UNREADABLE``, the names of a line's unreadable columns.

    A column ``LINE`` holds the text of lines of the wrong shape, null for sound ones. ``raise``
    ends the job that reads any cell of such a line; ``mark`` adds one of ``FAULTS`` to its names, and,
    where cells are missing or quotes broken, its numbers and dates that are not there.
    """
    if unreadable not in ("raise", "mark"):
        raise ValueError(f"unreadable must be 'raise' or 'mark', not {unreadable!r}")
    shaped = LINE in df.columns
    columns = [c for c in df.columns if c != LINE]
    line, fault = F.col(LINE), F.col("_fault")
    if shaped:  # found once for all cells
        df = df.withColumn("_fault", line_fault(line, len(columns)))
    # Cells from here on are not there.
    upto = F.when(fault == MISSING_CELLS, line_cells(line)).when(fault == BROKEN_QUOTES, 0)
    df = df.withColumns(
        {c: F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")) for c in columns}
    )
    cells, marks = {}, [fault] if shaped else []
    for at, header in enumerate(columns):
        name = RENAMES.get(header, header)
        text = F.col(f"`{header}`")
        if shaped and unreadable == "raise":
            message = F.concat(F.lit("line with "), fault, F.lit(": "), line)
            text = F.when(line.isNotNull(), F.raise_error(message).cast("string")).otherwise(text)
            cells[header] = text
        if name in NUMERIC:
            number = F.trim(text).try_cast("double")
            cell = F.when(F.abs(number) < float("inf"), number)
        elif name in DATES:
            cell = parse_date(F.trim(text), date_formats)
        else:
            continue
        bad = text.isNotNull() & cell.isNull()
        if unreadable == "raise":
            message = F.concat(F.lit(f"unreadable {name}: "), text)
            cell = F.when(bad, F.raise_error(message).cast(RAW[name].dataType)).otherwise(cell)
        cells[header] = cell
        if shaped:
            bad = bad | cell.isNull() & F.coalesce(upto <= at, F.lit(False))
        marks.append(F.when(bad, F.lit(name)))
    if unreadable == "mark":
        cells[UNREADABLE] = F.array_compact(F.array(*marks)).cast("array<string>")
    return df.withColumns(cells).drop(LINE, "_fault")


def read_raw(
    spark: SparkSession,
    path: str,
    date_formats: tuple[str, ...] = DATE_FORMATS,
    multi_line: bool = False,
    unreadable: str = "raise",
) -> DataFrame:
    """A raw CSV file with its own header names, numbers and dates parsed (see ``typed``).

    Only the header is read up front, so no pass over the file infers types. Lines with more or
    fewer cells than the header, or with a quote that is not closed, are of the wrong shape; a
    quote open only in the last cell takes nothing along and goes unnoticed. Set
    ``multi_line`` when quoted fields hold line breaks; such files cannot be split.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    header = check_columns(reader.csv(path)).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, LINE]])
    # Lines are compared with the header even if few of their cells are asked for.
    whole = reader.schema(schema).option("columnNameOfCorruptRecord", LINE).option("columnPruning", False)
    return typed(whole.csv(path), date_formats, unreadable)


def write_table(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    partition_by: str | None = "year",
    replace: str = "all",
    even: bool = True,
) -> None:
    """Write a cleaned table. Parquet is split by year, so that year filters skip files.

    Rebalancing gives files of even size: large years are cut up, small ones not
    scattered over every task. It shuffles the rows; ``even=False`` has each task write its own
    rows, into a file for each of their years, with neither a shuffle nor a sort. ``replace="present"`` replaces only the folders of years that
    ``df`` has rows of, once all its files are written; other folders are not touched, and a run
    that fails before leaves the old ones in place.
    """
    by_folder = partition_by is not None and format != "csv"
    if replace not in ("all", "present") or replace == "present" and not by_folder:
        raise ValueError(f"replace must be 'all', or 'present' for a table in folders, not {replace!r}")
    if even:
        df = df.hint("rebalance", partition_by) if by_folder else df.hint("rebalance")
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if by_folder:
        mode = "dynamic" if replace == "present" else "static"
        writer = writer.partitionBy(partition_by).option("partitionOverwriteMode", mode)
    with nullcontext() if even else _files_open(df.sparkSession, YEARS_OPEN):
        writer.save(path)


@contextmanager
def _files_open(spark: SparkSession, n: int) -> Iterator[None]:
    """Lets a task write to ``n`` folders at a time; rows of further ones are sorted first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def replace_years(df: DataFrame, path: str, years: list[int]) -> None:
    """Replace the given years of a table written by ``write_table`` by their rows in ``df``.

    The rows are staged first. A year that has none any more loses its folder, after the others
    are replaced.
    """
    wanted = stage(df.where(F.col("year").isin(years)), "years")
    present = {r["year"] for r in wanted.select("year").distinct().collect()}
    if present:
        write_table(wanted, path, replace="present")
    for year in sorted(set(years) - present):
        delete(df.sparkSession, f"{path}/year={year}")


def read_table(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A table written by ``write_table``."""
    if format != "csv":
        return spark.read.format(format).load(path)
    header = spark.read.option("header", True).option("escape", '"').csv(path)
    types = {f.name: f.dataType for f in RAW.fields} | {
        "quantity": "bigint",
        "year": "int",
        "month": "int",
        "quarter": "int",
        "days_to_ship": "int",
        "profit_margin_pct": "double",
        "revenue_per_unit": "double",
    }
    return header.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in header.columns})


def reporting_table(cleaned: DataFrame) -> DataFrame:
    """Cleaned lines as the reporting table: its columns, with exact money."""
    return cleaned.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SALES.fields])
