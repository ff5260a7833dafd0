"""Exact quantiles and modes of whole columns, without gathering a column anywhere.

Quantiles take two passes. Sketches of parts of the table first give each wanted
quantile a narrow bracket of values. Then only the values inside a bracket are
counted one by one, with everything below it as a single count; these counts are
range-partitioned, and the partitions holding a wanted position are walked.
"""

from __future__ import annotations

from math import ceil, floor, inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.ranking import PART, range_parts

# Sketches are exact to N / SKETCH positions, and merged in up to GROUPS tasks.
SKETCH = 1000
GROUPS = 512

Target = tuple[str, float]


def value_counts(long: DataFrame) -> DataFrame:
    """(target, value, n) of (target, value) rows; nulls are not counted."""
    return (
        long.where("value is not null")
        .groupBy("target", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    doubles = {c: F.col(c).cast("double") for c in columns}
    return df.select(*[F.when(F.abs(x) < inf, x).alias(c) for c, x in doubles.items()])


def quantiles(
    df: DataFrame, wanted: dict[str, list[float]], accuracy: int | None = None
) -> dict[Target, float]:
    """{(column, q): value}, interpolated linearly between neighbouring values.

    Exact unless ``accuracy`` asks for Spark's sketch alone. A column without
    values has no entry; infinities and NaN are no values.
    """
    numbers = _numbers(df, list(wanted))
    if accuracy is not None:
        return _sketched(numbers, wanted, accuracy)
    totals, brackets = _brackets(numbers, wanted)
    found = _walk(numbers, totals, brackets)
    # A bracket can miss its position when there are few rows: then it is opened.
    missed = {t: (None, None) for t in brackets if t not in found}
    return found | _walk(numbers, totals, missed) if missed else found


def _sketched(
    numbers: DataFrame, wanted: dict[str, list[float]], accuracy: int
) -> dict[Target, float]:
    row = numbers.agg(*[F.percentile_approx(c, qs, accuracy) for c, qs in wanted.items()]).first()
    return {
        (c, q): v for (c, qs), vs in zip(wanted.items(), row) if vs for q, v in zip(qs, vs)
    }


def _brackets(
    numbers: DataFrame, wanted: dict[str, list[float]]
) -> tuple[dict[str, int], dict[Target, tuple[float, float]]]:
    """How many values each column has, and values around each wanted quantile.

    Wherever rows lie, a quantile of the table is between the lowest and the
    highest of its parts' quantiles, so the parts' sketches are never merged in
    one task.
    """
    margin = 2 / SKETCH
    ends = {c: [e for q in qs for e in (max(q - margin, 0.0), min(q + margin, 1.0))]
            for c, qs in wanted.items()}
    sketches = (
        numbers.withColumn("_group", F.spark_partition_id() % GROUPS)
        .groupBy("_group")
        .agg(
            *[F.count(c).alias(f"n_{c}") for c in wanted],
            *[F.percentile_approx(c, ends[c], SKETCH).alias(f"s_{c}") for c in wanted],
        )
    )
    targets = [(c, q, 2 * i) for c, qs in wanted.items() for i, q in enumerate(qs)]
    row = sketches.agg(
        *[F.sum(f"n_{c}") for c in wanted],
        *[F.min(F.col(f"s_{c}")[i]) for c, _, i in targets],
        *[F.max(F.col(f"s_{c}")[i + 1]) for c, _, i in targets],
    ).first()
    totals = {c: n for c, n in zip(wanted, row) if n}
    lows, highs = row[len(wanted) : -len(targets)], row[-len(targets) :]
    brackets = {
        (c, q): (low, high) for (c, q, _), low, high in zip(targets, lows, highs) if c in totals
    }
    return totals, brackets


def _walk(
    numbers: DataFrame,
    totals: dict[str, int],
    brackets: dict[Target, tuple[float | None, float | None]],
) -> dict[Target, float]:
    """The quantiles whose neighbours lie inside their brackets."""
    if not brackets:
        return {}

    def bracketed(column: str, low: float | None, high: float | None) -> Column:
        x = F.col(column)
        return x if low is None else F.when(x < low, -inf).when(x <= high, x)

    names = {t: str(i) for i, t in enumerate(brackets)}
    long = numbers.select(
        *[bracketed(c, *ends).alias(names[c, q]) for (c, q), ends in brackets.items()]
    ).unpivot([], list(names.values()), "target", "value")
    parts = range_parts(value_counts(long), "target", "value", label="values")

    positions = {t: (totals[t[0]] - 1) * t[1] for t in brackets}
    neighbours = F.create_map(
        *[
            x
            for t, position in positions.items()
            for x in (F.lit(names[t]), F.array(F.lit(floor(position)), F.lit(ceil(position))))
        ]
    )
    # One row per target and partition, then two per target.
    up_to_part = Window.partitionBy("target").orderBy(PART)
    places = (
        parts.groupBy("target", PART)
        .agg(F.sum("n").alias("_n"))
        .withColumn("_before", F.sum("_n").over(up_to_part) - F.col("_n"))
        .withColumn("index", F.explode(F.array_distinct(neighbours[F.col("target")])))
        .where("index >= _before and index < _before + _n")
        .select("target", PART, "index", (F.col("index") - F.col("_before")).alias("_local"))
    )
    in_part = Window.partitionBy("target", "index").orderBy("value")
    rows = (
        parts.join(F.broadcast(places), ["target", PART])
        .withColumn("_upto", F.sum("n").over(in_part))
        .where("_upto > _local and _upto - n <= _local")
        .select("target", "index", "value")
        .collect()
    )
    values = {(r["target"], r["index"]): r["value"] for r in rows if r["value"] != -inf}
    found = {}
    for t, position in positions.items():
        low = values.get((names[t], floor(position)))
        high = values.get((names[t], ceil(position)))
        if low is not None and high is not None:
            found[t] = low + (high - low) * (position - floor(position))
    return found


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """{column: most frequent value}, the smallest one on ties."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "target", "value"
    )
    best = F.min(F.struct((-F.col("n")).alias("_n"), F.col("value").alias("value")))
    rows = value_counts(long).groupBy("target").agg(best.alias("_best")).collect()
    return {r["target"]: r["_best"]["value"] for r in rows}
