"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, packed

EDGE_BYTES = 16


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest neighbour (or itself)."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, go to the smallest of them. Edges point from a to a smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node but the roots; a root is its component's smallest node.

    ``edges`` has long columns a and b. Each round is written to the shared folder. No edge or label reaches the
    driver, only counts and checksums do.
    """
    now = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialize(packed(now, edges.count(), EDGE_BYTES), "edges"), None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state[0] == 0 or state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        now = materialize(packed(_small_star(_large_star(now)), state[0], EDGE_BYTES), "stars")
    raise RuntimeError("components did not settle")
