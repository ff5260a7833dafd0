"""Best-fit packing of documents into bins of a fixed number of words, without conflicts.

A bin holds at most one piece of a source and at most one of a duplicate cluster. It
carries both as bitmaps. Open bins are kept in the order of their room; from the tightest
that is large enough the search goes on to its successors until one is compatible.

Documents over the capacity are cut; full pieces have a bin of their own. Pieces are dealt to
shards by a hash, so sources, clusters and long documents spread evenly; the number of
shards follows the words and the pieces, which keeps every shard near ``SHARD_BINS`` bins' worth
of words and ``SHARD_PIECES`` pieces, however short texts are.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.words import group_sums, mix, pieces, words
from tillroll.staging import stage

CAPACITY = 2048
SHARD_BINS = 512
SHARD_PIECES = 16_384

_RESULT = (
    "bin_id long, slot int, doc_id long, piece int, first_word long, n_words long, source string, cluster long"
)


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """A bin number for each piece, in the given order. Sources below zero never conflict."""
    room: list[tuple[int, int]] = []  # (residual, bin), in order
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    chosen = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        source_bit = 1 << source if source >= 0 else 0
        cluster_bit = 1 << cluster
        at = bisect_left(room, (size, -1))
        while at < len(room):
            found = room[at][1]
            if not (source_bits[found] & source_bit or cluster_bits[found] & cluster_bit):
                break
            at += 1
        if at < len(room):
            left, found = room.pop(at)
        else:
            left, found = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[found] |= source_bit
        cluster_bits[found] |= cluster_bit
        insort(room, (left - size, found))
        chosen.append(found)
    return chosen


def _pack_shard(capacity: int):
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(
            ["n_words", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable"
        ).reset_index(drop=True)
        # Small numbers for the bitmaps of this shard.
        sources = pd.factorize(shard["source"])[0]
        clusters = pd.factorize(shard["cluster"])[0]
        bins = best_fit(shard["n_words"].tolist(), sources.tolist(), clusters.tolist(), capacity)
        out = shard.assign(bin_id=(shard["shard"].astype(np.int64) * (1 << 32)) + np.array(bins, dtype=np.int64))
        out["slot"] = out.groupby("bin_id").cumcount().astype(np.int32)
        return out[["bin_id", "slot", "doc_id", "piece", "first_word", "n_words", "source", "cluster"]]

    return pack


def word_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows ``doc_id, source, total, cluster``; texts with the same words in order share a cluster."""

    def scan(batches):
        for part in pieces(batches):
            found = words(part.column("text"))
            counts = found.counts
            place = np.arange(len(found.starts)) - np.repeat(found.first[:-1], counts)
            each = mix(found.hashes() ^ mix(place.astype(np.uint64) + np.uint64(1)))
            cluster = mix(group_sums(each.view(np.int64), found.first).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("source"), pa.array(counts), pa.array(cluster)],
                names=["doc_id", "source", "total", "cluster"],
            )

    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.col(text_col).cast("string").alias("text"),
    )
    return chosen.mapInArrow(scan, "doc_id long, source string, total long, cluster long")


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    capacity: int = CAPACITY,
    shard_bins: int = SHARD_BINS,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Rows ``bin_id, slot, doc_id, piece, first_word, n_words, source, cluster``: every word of every
    document once.

    Pieces are taken from long to short, ties by id, piece, cluster and source. Texts that
    are null or without words are one piece of no words. A null source conflicts with
    nothing; texts without words are copies of each other. Repeated rows are packed as often
    as they come, into different bins.
    """
    counted = stage(word_counts(docs, id_col, text_col, source_col), "words")
    cut = counted.select(
        "*",
        F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / capacity).cast("int") - 1, F.lit(0)))).alias(
            "piece"
        ),
    )
    first = F.col("piece").cast("long") * capacity
    cut = cut.withColumn("first_word", first).withColumn(
        "n_words", F.least(F.col("total") - F.col("first_word"), F.lit(capacity).cast("long"))
    )
    each = F.greatest(F.ceil(F.col("total") / capacity), F.lit(1))
    total, cuts = (n or 0 for n in counted.agg(F.sum("total"), F.sum(each)).first())
    shards = max(1, -(-total // (capacity * shard_bins)), -(-cuts // shard_pieces))
    spread = F.xxhash64("doc_id", "piece", "cluster")
    dealt = cut.withColumn("shard", F.pmod(spread, F.lit(shards)).cast("long")).drop("total")
    return dealt.groupBy("shard").applyInPandas(_pack_shard(capacity), _RESULT)
