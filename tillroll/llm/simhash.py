"""SimHash near-duplicates by multi-index hashing.

Fingerprint: lower-cased words, word shingles joined by a space, XXH64 with seed 42 of
each, repeats included; a bit is set if it is set in over half of the hashes. A text with
fewer words than a shingle is hashed whole; one without words has fingerprint zero.

Two fingerprints at most ``radius`` bits apart have a segment in which they differ by
at most ``radius // segments`` bits. Every distinct fingerprint is filed under each of its
segments, every segment's small Hamming ball is enumerated and looked up, and the whole
distance of each match is verified. Equal fingerprints are one node with their smallest
id, so copies never form pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.graph import components
from tillroll.llm.words import LOWER, SPACE, pieces, words
from tillroll.staging import stage

SHINGLE = 3
RADIUS = 3
SEGMENTS = 2

_PLAIN = np.where(SPACE, np.uint8(0x20), LOWER)


def _text_fingerprint(low: bytes, starts: list[int], ends: list[int], shingle: int) -> int:
    n = len(starts)
    if n == 0:
        return 0
    if ends[-1] - starts[0] != sum(ends) - sum(starts) + n - 1:  # wider gaps than one space
        parts = low.split()
        low = b" ".join(parts)
        ends = (np.cumsum([len(p) + 1 for p in parts]) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[:-1])]
    if n < shingle:
        hashes = [xxhash.xxh64_intdigest(low[starts[0] : ends[-1]], 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(low[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :], strict=False)]
    votes = np.zeros(64, dtype=np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[begin : begin + (1 << 16)], dtype="<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    bits = votes * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def text_fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a column of texts, as unsigned 64-bit numbers."""
    found = words(column)
    low = _PLAIN[found.raw].tobytes()
    first = found.first.tolist()
    out = []
    for begin, end in zip(first, first[1:], strict=False):
        if begin == end:
            out.append(0)
            continue
        at, upto = int(found.starts[begin]), int(found.ends[end - 1])
        out.append(
            _text_fingerprint(
                low[at:upto],
                (found.starts[begin:end] - at).tolist(),
                (found.ends[begin:end] - at).tolist(),
                shingle,
            )
        )
    return np.array(out, dtype=np.uint64)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """Rows ``id, fp`` (the fingerprint as a signed 64-bit number) for every row of ``docs``."""

    def scan(batches):
        for part in pieces(batches):
            fps = text_fingerprints(part.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps)], names=["id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(scan, "id long, fp long")


def _segments(segments: int) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _ball(width: int, radius: int) -> list[int]:
    """Every mask of ``width`` bits with at most ``radius`` of them set."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """Pairs ``fp, other`` of different fingerprints at most ``radius`` bits apart (``fp`` above ``other``)."""
    tables, probes = [], []
    for n, (low, width) in enumerate(_segments(segments)):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        tables.append(F.struct(F.lit(n).alias("part"), value.alias("value")))
        probes += [
            F.struct(F.lit(n).alias("part"), value.bitwiseXOR(F.lit(mask).cast("long")).alias("value"))
            for mask in _ball(width, radius // segments)
        ]
    index = distinct.select(F.col("fp").alias("other"), F.explode(F.array(*tables)).alias("at"))
    probe = distinct.select("fp", F.explode(F.array(*probes)).alias("at"))
    found = probe.select("fp", "at.part", "at.value").join(
        index.select("other", "at.part", "at.value"), ["part", "value"]
    )
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    return found.where(F.col("fp") > F.col("other")).where(near).select("fp", "other").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    segments: int = SEGMENTS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``radius``
    differing bits, its own id included. Null texts are empty; empty texts share
    fingerprint zero. A null id counts as larger than every other one and is kept.
    Repeated rows give repeated results; other columns are not read.
    """
    found = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    # Nodes are the distinct fingerprints; one of them stands for all copies of a text.
    nodes = stage(found.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    groups = components(fingerprint_links(nodes.select("fp"), radius, segments), "fp", "other")
    grouped = nodes.join(groups, nodes.fp == groups.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "component").select("fp", "component_id")
    return found.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group, the one with the smallest id.

    Rows that share that id are told apart by their text; of rows equal in both, one stays.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
    )

    def scan(batches):
        for part in pieces(batches):
            fps = text_fingerprints(part.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("mark"), pa.array(fps)], names=["id", "mark", "fp"]
            )

    marked = rows.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()))
    found = stage(marked.mapInArrow(scan, "id long, mark long, fp long"), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("least")
    nodes = stage(found.groupBy("fp").agg(first), "nodes")
    groups = components(fingerprint_links(nodes.select("fp"), radius), "fp", "other")
    grouped = nodes.join(groups, nodes.fp == groups.node, "left").select(
        F.coalesce("component", "fp").alias("component"), "least"
    )
    kept = grouped.groupBy("component").agg(F.min("least").alias("least"))
    kept = kept.select(
        F.col("least.none").alias("_kept_none"),
        F.coalesce("least.id", F.lit(0)).alias("_kept_id"),
        F.col("least.mark").alias("_kept_mark"),
    ).distinct()
    text = F.col(text_col).cast("string")
    own = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"),
        F.col(id_col).isNull().alias("_kept_none"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_kept_id"),
        F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("_kept_mark"),
    )
    keys = ["_kept_none", "_kept_id", "_kept_mark"]
    copies = Window.partitionBy(*keys).orderBy(*keys)
    stays = own.join(kept, keys).withColumn("_copy", F.row_number().over(copies))
    return stays.where("_copy = 1").select("_row.*")
