"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.staging import stage

_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """For each node at ``a`` the least of itself and its neighbours."""
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(_least(both), "a").where("b > a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    linked = down.join(_least(down), "a")
    kept = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = linked.select("a", F.col("m").alias("b"))
    return kept.union(own).where("a != b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows ``node, component`` for every node that has a link to another one.

    ``component`` is the smallest node reachable. Links may be repeated, in either
    direction, or join a node to itself (ignored); links with a null end are ignored.
    Each round is written to the checkpoint folder, and stars end at the least
    node, so no list of neighbours is ever gathered: hot nodes only enter as
    map-side minima and as skewed join keys.
    """
    edges = (
        links.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    edges = stage(edges, "links")
    print_of = None
    for _ in range(_ROUNDS):
        # Once every node points at the least node of its component, nothing changes any more.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == print_of or not now[0]:
            break
        print_of = tuple(now)
        edges = stage(_small_star(_large_star(edges)), "links")
    else:
        raise RuntimeError("components did not settle")
    # Settled edges are stars: a node, and the least node of its component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
