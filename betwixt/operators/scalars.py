"""Graph scalars and the relational operators beneath them. Edges are (src, dst), both ways."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written


#: Of a column of node ids, the graph that each node is in (see ``forest``); None where there is one graph.
GraphOf = Callable[[Column], Column] | None


def beside(rows: DataFrame, totals_of: DataFrame, *aggregates: Column, graph: GraphOf = None, node: str = "node") -> DataFrame:
    """``rows`` with the aggregates of ``totals_of`` (with a column node), over all of it or over the row's graph."""
    if graph is None:
        return rows.join(F.broadcast(totals_of.agg(*aggregates)))  # one row
    totals = totals_of.groupBy(graph(F.col("node")).alias("__graph")).agg(*aggregates)
    return rows.withColumn("__graph", graph(F.col(node))).join(totals, "__graph").drop("__graph")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, deg). On a multigraph parallel edges count, and a loop (stored twice) counts two."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))


def summary(edges: DataFrame) -> DataFrame:
    """One row: n, m, avg_deg, max_deg."""
    return degrees(edges).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce((F.sum("deg") / 2).cast("long"), F.lit(0)).alias("m"),
        F.avg("deg").alias("avg_deg"),
        F.max("deg").alias("max_deg"),
    )


#: What keeps the base of distance weights above 1.
FLOORS = {
    "none": lambda x: x,
    "jump": lambda x: F.when(x < 1.0, F.lit(1.01)).otherwise(x),
    "level": lambda x: F.greatest(x, F.lit(1.001)),
    "plain": lambda x: F.greatest(x, F.lit(1.01)),
}


def floored(avg_deg: Column, how: str = "jump") -> Column:
    return FLOORS[how](avg_deg)


def top_degree(edges: DataFrame, k: int = 1) -> DataFrame:
    """The k nodes of highest degree, ties to the lowest id."""
    return degrees(edges).orderBy(F.desc("deg"), "node").limit(k)


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("deg").agg(F.count(F.lit(1)).alias("nodes"))


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the number of common neighbours and the Jaccard similarity of the neighbour sets."""
    x = edges.select(F.col("src").alias("u"), F.col("dst").alias("x"))
    y = edges.select(F.col("src").alias("v"), F.col("dst").alias("x"))
    common = pairs.select("u", "v").distinct().join(x, "u").join(y, ["v", "x"]).groupBy("u", "v").agg(F.count(F.lit(1)).alias("common"))
    deg = degrees(edges)
    out = (
        pairs.join(common, ["u", "v"], "left")
        .join(deg.select(F.col("node").alias("u"), F.col("deg").alias("du")), "u", "left")
        .join(deg.select(F.col("node").alias("v"), F.col("deg").alias("dv")), "v", "left")
    )
    n = F.coalesce("common", F.lit(0))
    union = F.coalesce("du", F.lit(0)) + F.coalesce("dv", F.lit(0)) - n
    return out.withColumn("common", n).withColumn("jaccard", F.when(union > 0, n / union).otherwise(F.lit(0.0))).drop("du", "dv")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id of the node's component.

    Each node points at its smallest neighbour (or itself); pointers are followed to their ends, which costs rounds over nodes
    that grow with the logarithm of a chain, and the edges between different ends are the next round's graph. Edges are
    therefore evaluated twice, whatever the rounds (write costly ones first): what is left after the first is a small part. Each round is written
    out; only a count of changes reaches the driver. Tables that grow are joined by sorting: a written table is small on disk
    long before its rows are few enough to be sent through the driver.
    """
    rounds: list[DataFrame] = []
    while True:
        to = written(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.col("src"), F.min("dst")).alias("to")), "labels")
        while True:
            far = to.select(F.col("node").alias("to"), F.col("to").alias("far")).hint("merge")
            step = written(to.join(far, "to").select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "labels")
            to = step.select("node", "to")
            if step.filter("moved").isEmpty():
                break
        rounds.append(to)
        ends = edges.filter("src < dst")
        for end in ("src", "dst"):
            ends = ends.join(to.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")).hint("merge"), end)
        low, high = F.least("src_to", "dst_to").alias("src"), F.greatest("src_to", "dst_to").alias("dst")
        left = written(ends.filter("src_to <> dst_to").select(low, high).distinct(), "edges")
        if left.isEmpty():
            break
        edges = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    out = rounds.pop().withColumnRenamed("to", "component")
    while rounds:
        last = out.withColumnRenamed("node", "to").hint("merge")
        out = rounds.pop().join(last, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return out


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the largest component (ties to the smallest label)."""
    edges = written(edges, "edges")
    labels = written(connected_components(edges), "labels")
    best = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = labels.join(F.broadcast(best), "component", "left_semi").select(F.col("node").alias("src"))
    return edges.join(inside.hint("merge"), "src", "left_semi")


def nonzero_summary(bc: DataFrame) -> DataFrame:
    """Least, greatest and number of the values above 0."""
    x = F.when(F.col("bc") > 0, F.col("bc"))
    return bc.agg(F.min(x).alias("min_bc"), F.max(x).alias("max_bc"), F.count(x).alias("nonzero"), F.count(F.lit(1)).alias("n"))


def downsampled(edges: DataFrame, most_nodes: int, seed: int = 0) -> DataFrame:
    """The subgraph induced by ``most_nodes`` nodes, chosen by a hash of their ids."""
    chosen = edges.select(F.col("src").alias("node")).distinct().orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(most_nodes)
    for end in ("src", "dst"):
        edges = edges.join(chosen.withColumnRenamed("node", end), end, "left_semi")
    return edges.select("src", "dst")
