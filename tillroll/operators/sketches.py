"""Estimates from stored sketches: distinct counts (HyperLogLog) and quantiles (KLL) that can be merged.

A sketch is kept for each key and figure, say each month and region. Sketches of one figure are merged
over any of the keys, so a new month adds its own rows and no line is read again. Sizes don't grow
with the lines: 2^``LG_K`` registers, and some ``K`` values for every doubling of the lines.

Distinct counts are off by more than ``distinct_error()`` about once in twenty, quantiles by more than
``rank_error()`` of the ranks about once in a hundred. Counts up to some hundreds are as good as exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 13
K = 400


def distinct_error(lg_k: int = LG_K) -> float:
    """Two standard errors of a merged distinct count, as a share of it."""
    return 2 * 1.04 / 2 ** (lg_k / 2)


def rank_error(k: int = K) -> float:
    """The normalised rank error of one quantile at 99 % confidence, as its authors fitted it."""
    return 2.296 / k**0.9723


def sketch(df: DataFrame, keys: list[str], ids: list[str], values: list[str], lg_k: int = LG_K, k: int = K) -> DataFrame:
    """Rows ``keys, ids_<c>, values_<c>``: a sketch of each column, merged map-side.

    Nulls are not counted, null keys are keys of their own. Sketches that are to be merged must have been
    made with the same ``lg_k`` and ``k``.
    """
    return df.groupBy(*keys).agg(
        *[F.hll_sketch_agg(c, lg_k).alias(f"ids_{c}") for c in ids],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"values_{c}") for c in values],
    )


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches over fewer keys, or of several tables with the same columns in a union."""
    merged = [F.hll_union_agg(c).alias(c) for c in sketches.columns if c.startswith("ids_")]
    merged += [F.kll_merge_agg_double(c).alias(c) for c in sketches.columns if c.startswith("values_")]
    return sketches.groupBy(*keys).agg(*merged)


def estimates(sketches: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Rows ``keys, distinct_<c>, quantiles_<c>``: counts, and values at ``quantiles``, over ``keys``.

    Quantiles of a column without values are null.
    """
    merged = merge_sketches(sketches, keys)
    ranks = F.array(*[F.lit(float(q)) for q in quantiles])
    found = []
    for c in merged.columns:
        if c.startswith("ids_"):
            found.append(F.hll_sketch_estimate(c).alias(f"distinct_{c.removeprefix('ids_')}"))
        elif c.startswith("values_"):
            some = F.kll_sketch_get_n_double(c) > 0
            values = F.when(some, F.kll_sketch_get_quantile_double(c, ranks))
            found.append(values.alias(f"quantiles_{c.removeprefix('values_')}"))
    return merged.select(*keys, *found)
