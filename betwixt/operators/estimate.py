"""Drawing pivots, estimating betweenness from their dependencies, and ordering nodes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import key, uniform
from ..functions.lineage import written
from . import traverse
from .ranks import with_rank

SWEEP = [1, *range(5, 51, 5)]
BLOCK = 1 << 19  # rows of distributions that are sorted together


def draw_pivots(probs: DataFrame, t_most: int, seed: int = 0, by: tuple[str, ...] = ("target",), block: int | None = None) -> DataFrame:
    """(*by, t, node, p) for t = 1 .. t_most: the node at which the running sum of p first reaches the draw.

    ``by`` names a distribution (target, or method and target); draws depend on target and t only, so methods share them.
    Sums are in two levels: rows are cut into ranges of (by, node) of about ``block`` rows, a draw finds its range among
    the ranges' totals and then its node among the range's rows, in one sorted pass over both (linear work). So no task
    holds a distribution, however many nodes it has.
    """
    rows = written(probs.select(*by, "node", "p"), "distributions")
    parts = max(1, math.ceil(rows.count() / (block or BLOCK)))
    ranged = written(rows.repartitionByRange(parts, *by, "node").withColumn("range", F.spark_partition_id()), "ranges")
    order = Window.partitionBy(*by).orderBy("range")  # a row for each range
    totals = ranged.groupBy(*by, "range").agg(F.sum("p").alias("own"))
    totals = totals.select(
        *by, "range", F.coalesce(F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"), F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.lag("range").over(order).isNull().alias("first"), F.lead("range").over(order).isNull().alias("last"),
    )
    totals = written(totals, "range-totals")
    draws = probs_keys(rows, by, t_most, seed).join(totals, list(by))
    above, upto = F.col("first") | (F.col("x") > F.round("before", 12)), F.col("last") | (F.col("x") <= F.round("upto", 12))
    draws = draws.filter(above & upto).select(*by, "range", "x", "t", F.lit(None).cast("long").alias("node"), F.lit(None).cast("double").alias("p"))
    keys = [*by, "range"]
    inner = F.sum("p").over(Window.partitionBy(*keys).orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    cum = ranged.join(totals.select(*keys, "before"), keys).select(*keys, F.round(F.col("before") + inner, 12).alias("x"), F.lit(None).cast("int").alias("t"), "node", "p")
    # from the greatest x down, the last node seen is the first whose running sum reaches the draw; the frame only
    # grows, so the pass is linear. A draw beyond the last running sum takes the last node.
    down = Window.partitionBy(*keys).orderBy(F.desc("x"), F.col("t").asc_nulls_first(), F.desc("node"))
    hit = F.when(F.col("node").isNotNull(), F.struct("node", "p"))
    last = F.first(hit, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pick = F.coalesce(F.last(hit, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)), last)
    return cum.unionByName(draws).withColumn("pick", pick).filter(F.col("t").isNotNull()).select(*by, "t", "pick.node", "pick.p")


def probs_keys(rows: DataFrame, by: tuple[str, ...], t_most: int, seed: int) -> DataFrame:
    """(*by, t, x): the draws of each distribution."""
    draws = rows.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(1), F.lit(t_most))).alias("t"))
    return draws.withColumn("x", uniform(key(F.col("target"), F.col("t"), seed=seed)))


def contributions(edges: DataFrame, draws: DataFrame) -> DataFrame:
    """(target, t, node, p, delta, value): value = delta / p. Each distinct pivot is traversed once for all targets."""
    draws = written(draws, "draws")  # read twice: for the pivots and for the values
    dep = traverse.dependencies(edges, draws.select("node"), targets=draws.select("target")).select(F.col("source").alias("node"), F.col("node").alias("target"), "delta")
    delta = F.coalesce("delta", F.lit(0.0))
    return draws.join(dep, ["node", "target"], "left").select(*draws.columns, delta.alias("delta"), (delta / F.greatest("p", F.lit(1e-12))).alias("value"))


def estimates(values: DataFrame, sweep: list[int] | None = None, scale: float = 0.5) -> DataFrame:
    """(target, steps, est) from the first ``steps`` draws, for every entry of the sweep at once.

    Exact values count unordered pairs, hence the default scale of one half; 1 for the unhalved form.
    """
    steps = F.explode(F.array(*[F.lit(x) for x in (sweep or SWEEP)])).alias("steps")
    run = values.select("target", "t", "value", steps).filter(F.col("t") <= F.col("steps"))
    return run.groupBy("target", "steps").agg((F.sum("value") / F.col("steps") * scale).alias("est"))


def trimmed_estimates(values: DataFrame, t: int = 25, cut: float = 0.1, scale: float = 0.5) -> DataFrame:
    """(target, est): the mean without the max(1, cut * k) least and greatest of k contributions; of all if none is left."""
    w = Window.partitionBy("target")
    ranked = values.filter(F.col("t") <= t).select(
        "target", "value", F.row_number().over(w.orderBy("value", "t")).alias("r"), F.count(F.lit(1)).over(w).alias("k")
    )
    drop = F.greatest(F.lit(1), F.floor(F.col("k") * cut))
    inner = F.when((F.col("r") > drop) & (F.col("r") <= F.col("k") - drop), F.col("value"))
    return ranked.groupBy("target").agg((F.coalesce(F.avg(inner), F.avg("value")) * scale).alias("est"))


def adaptive_estimates(values: DataFrame, tolerance: float = 0.15, least: int = 5, scale: float = 0.5) -> DataFrame:
    """(target, used, est): stops at the first t >= least whose standard error is within tolerance of the mean."""
    w = Window.partitionBy("target").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = values.select(
        "target", "t", F.avg("value").over(w).alias("mean"), (F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0)) / F.sqrt("t")).alias("se")
    )
    good = (F.col("t") >= least) & (F.col("se") <= tolerance * F.abs("mean"))
    stop = F.coalesce(F.min(F.when(good, F.col("t"))), F.max("t"))
    at = run.groupBy("target").agg(stop.alias("used"))
    return run.join(at, "target").filter(F.col("t") == F.col("used")).select("target", "used", (F.col("mean") * scale).alias("est"))


def pair_order(values: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """pairs (u, v) with both values and ``greater``: u's is strictly greater."""
    ids = values.columns[0]
    u = values.select(F.col(ids).alias("u"), F.col(value).alias(f"{value}_u"))
    v = values.select(F.col(ids).alias("v"), F.col(value).alias(f"{value}_v"))
    return pairs.join(u, "u").join(v, "v").withColumn("greater", F.col(f"{value}_u") > F.col(f"{value}_v"))


def verdicts(ordered: DataFrame, value: str) -> DataFrame:
    """Which of a pair is greater: A (u), B (v) or Equal."""
    a, b = F.col(f"{value}_u"), F.col(f"{value}_v")
    return ordered.withColumn("verdict", F.when(a > b, "A").when(a < b, "B").otherwise("Equal"))


def k_ordering(values: DataFrame, value: str, k: int | None = None) -> DataFrame:
    """Nodes in descending order of value with their rank; ties to the lowest id."""
    ids = values.columns[0]
    if k is None:
        return with_rank(values, "rank", [F.desc(value), F.col(ids)])
    return values.orderBy(F.desc(value), ids).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), ids)))


def unordered_pairs(nodes: DataFrame) -> DataFrame:
    """All pairs u < v of a (small) list of nodes, such as the targets of a top-k report."""
    c = nodes.columns[0]
    return nodes.select(F.col(c).alias("u")).join(nodes.select(F.col(c).alias("v")), F.col("u") < F.col("v"))
