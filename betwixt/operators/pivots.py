"""Pivot distributions: for a target, the probability of each node to be drawn as a source.

All models give (target, node, p) over reached nodes other than the target, with probabilities that sum to 1 for each
target. They share one traversal; everything else is joins and window sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import traverse
from .scalars import GraphOf, beside, degrees, floored

EPS = 1e-9


def share(w: Column, *by: str) -> Column:
    return w / F.sum(w).over(Window.partitionBy(*by))


def candidates(edges: DataFrame, targets: DataFrame, floor: str = "jump", graph: GraphOf = None) -> DataFrame:
    """(target, node, d, sigma, parent, deg, lam) of every reached node other than the target; lam is the graph's."""
    reached = traverse.bfs(edges, targets).withColumnRenamed("source", "target").filter("d > 0")
    deg = degrees(edges)
    return beside(reached.join(deg, "node"), deg, floored(F.avg("deg"), floor).alias("lam"), graph=graph)


def _finish(rows: DataFrame, weight: Column) -> DataFrame:
    return rows.withColumn("__w", weight).select("target", "node", share(F.col("__w"), "target").alias("p"))


def decay(base: str = "lam") -> Column:
    return F.pow(F.col(base), -F.col("d"))


def eddbm(edges: DataFrame, targets: DataFrame, variant: str = "level", graph: GraphOf = None) -> DataFrame:
    """Distance and degree. Variants: flat, level (default), paper (times the level's size), level_sq (its square)."""
    if variant == "flat":
        return _finish(candidates(edges, targets, graph=graph), decay() / F.greatest(F.lit(1), F.col("deg")))
    rows = candidates(edges, targets, "level" if variant == "level_sq" else "jump", graph)
    inverse = 1 / (F.col("deg") + EPS) if variant == "level_sq" else 1 / F.col("deg").cast("double")
    weight = decay() * share(inverse, "target", "d")
    size = F.count(F.lit(1)).over(Window.partitionBy("target", "d"))
    power = {"level": 0, "paper": 1, "level_sq": 2}[variant]
    for _ in range(power):
        weight = weight * size
    return _finish(rows, weight)


def neighbour_degree_sums(edges: DataFrame) -> DataFrame:
    """(node, wdeg): the sum of the neighbours' degrees."""
    deg = degrees(edges).withColumnRenamed("node", "dst")
    return edges.join(deg, "dst").groupBy(F.col("src").alias("node")).agg(F.sum("deg").alias("wdeg"))


def weddbm(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Level mean degree to the minus distance, over the neighbours' degree sum."""
    mean = F.avg("deg").over(Window.partitionBy("target", "d"))
    rows = candidates(edges, targets).join(neighbour_degree_sums(edges), "node").withColumn("lev", F.when(mean < 1, F.lit(1.01)).otherwise(mean))
    return _finish(rows, decay("lev") / F.greatest(F.lit(1), F.col("wdeg")))


def parent_overlap(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (target, node, parent, deg, ...) with chat: the share of the node's neighbours that the parent has too.

    Each (node, parent) pair is an edge, so the wedges are counted once per edge, not once per target.
    """
    pairs = rows.select("node", "parent").distinct()
    x = edges.select(F.col("src").alias("node"), F.col("dst").alias("x"))
    y = edges.select(F.col("src").alias("parent"), F.col("dst").alias("x"))
    both = pairs.join(x, "node").join(y, ["parent", "x"]).groupBy("node", "parent").agg(F.count(F.lit(1)).alias("common"))
    return rows.join(both, ["node", "parent"], "left").withColumn("chat", F.coalesce("common", F.lit(0)) / F.greatest(F.lit(1), F.col("deg")))


def caeddbm(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Clustering-aware: a node that shares neighbours with its parent weighs less."""
    rows = parent_overlap(edges, candidates(edges, targets))
    return _finish(rows, decay() / (F.col("deg") * (1 + F.col("chat"))))


def pdeddbm(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Path density: the number of shortest paths."""
    return _finish(candidates(edges, targets), F.col("sigma") / (F.col("deg") * F.pow("lam", F.col("d"))))


def uniform(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """1 / (n - 1) on every node but the target, reached or not."""
    nodes = edges.select(F.col("src").alias("node")).distinct()
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    wanted = targets.select(F.col(targets.columns[0]).alias("target"))
    # every node for every target is the result itself
    return nodes.join(wanted, F.col("node") != F.col("target")).join(F.broadcast(n)).select("target", "node", (1 / (F.col("n") - 1)).alias("p"))


def fusion(edges: DataFrame, targets: DataFrame, learned: DataFrame | None = None, weight: float = 0.5) -> DataFrame:
    """Mean of the three refined models; blended with learned probabilities where there are any."""
    parts = weddbm(edges, targets).unionByName(caeddbm(edges, targets)).unionByName(pdeddbm(edges, targets))
    mean = parts.groupBy("target", "node").agg((F.sum("p") / 3).alias("p"))
    if learned is not None:
        ml = learned.select("target", "node", F.col("p").alias("ml"))
        known = learned.select("target").distinct().withColumn("has", F.lit(True))
        mean = mean.join(ml, ["target", "node"], "left").join(known, "target", "left")
        blend = (1 - weight) * F.col("p") + weight * F.coalesce("ml", F.lit(0.0))
        mean = mean.withColumn("p", F.when(F.col("has"), blend).otherwise(F.col("p")))
    return _finish(mean, F.col("p"))


def smoothed(edges: DataFrame, probs: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """(1 - epsilon) P + epsilon / (n - 1) on every node but the target, renormalised."""
    base = uniform(edges, probs.select("target").distinct()).withColumnRenamed("p", "u")
    mixed = base.join(probs, ["target", "node"], "left").withColumn("p", (1 - epsilon) * F.coalesce("p", F.lit(0.0)) + epsilon * F.col("u"))
    return _finish(mixed, F.col("p"))


def from_scores(rows: DataFrame, score: str, link: str = "exp") -> DataFrame:
    """A learned model's log scores (target, node, score) as probabilities, by exp or expm1 clipped at 0."""
    w = F.exp(score) if link == "exp" else F.greatest(F.expm1(score), F.lit(0.0))
    return rows.withColumn("__w", F.greatest(w, F.lit(0.0))).select(
        "target", "node", (F.col("__w") / (F.sum("__w").over(Window.partitionBy("target")) + 1e-12)).alias("p")
    )


MODELS = {
    "flat": lambda e, t: eddbm(e, t, "flat"),
    "level": lambda e, t: eddbm(e, t, "level"),
    "paper": lambda e, t: eddbm(e, t, "paper"),
    "level_sq": lambda e, t: eddbm(e, t, "level_sq"),
    "weddbm": weddbm,
    "caeddbm": caeddbm,
    "pdeddbm": pdeddbm,
    "fusion": fusion,
    "uniform": uniform,
}
