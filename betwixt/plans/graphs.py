"""Graphs derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.edges import canonical, symmetric


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, other: str) -> DataFrame:
    """(a, b) of every line of an order: its customer (2k), and its supplier or part (2k + 1)."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", other)
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return pairs.select((F.col("o_custkey") * 2).alias("a"), (F.col(other) * 2 + 1).alias("b"))


def trade_graph(spark: SparkSession, sf_dir: str, least_lines: int = 2) -> DataFrame:
    """Customers and suppliers, joined by at least ``least_lines`` of all order lines."""
    counted = _lines(spark, sf_dir, "l_suppkey").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return symmetric(canonical(counted.filter(F.col("n") >= least_lines).select("a", "b")))


def month_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, a, b): customers and suppliers, joined by any line of an order of the month, for each month (year * 12 + month)."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("graph_id"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("graph_id", (F.col("o_custkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).distinct()


def month_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, src, dst): ``month_pairs``, both ways."""
    pairs = month_pairs(spark, sf_dir)
    return pairs.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select("graph_id", F.col("b").alias("src"), F.col("a").alias("dst")))


def basket_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and parts, joined by any order line."""
    return symmetric(canonical(_lines(spark, sf_dir, "l_partkey")))


def session_graph(spark: SparkSession, sf_dir: str, least_times: int = 2) -> DataFrame:
    """Users next to each other in the order of (ts, event_id), at least ``least_times`` times.

    The order is global, but no task sees all events: neighbours are found in each hour, and the hours' first and last
    events are linked by a window over hours.
    """
    events = _read(spark, sf_dir, "events").select("ts", "event_id", "user_id").withColumn("hour", F.date_trunc("hour", "ts"))
    inside = events.withColumn("nxt", F.lead("user_id").over(Window.partitionBy("hour").orderBy("ts", "event_id"))).select("user_id", "nxt")
    order = F.struct("ts", "event_id")
    hours = events.groupBy("hour").agg(F.min_by("user_id", order).alias("first"), F.max_by("user_id", order).alias("user_id"))
    across = hours.select("user_id", F.lead("first").over(Window.orderBy("hour")).alias("nxt"))
    pairs = inside.unionByName(across).filter(F.col("nxt").isNotNull() & (F.col("nxt") != F.col("user_id")))
    counted = pairs.groupBy(F.least("user_id", "nxt").alias("a"), F.greatest("user_id", "nxt").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return symmetric(counted.filter(F.col("n") >= least_times).select("a", "b"))


GRAPHS = {"trade": trade_graph, "basket": basket_graph, "session": session_graph}
