"""Training sets from exact values, dependencies and features. Sampling is by counter-based draws, never by rand()."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import key, uniform
from ..functions.lineage import written
from . import traverse
from .features import pivot6, pivot13
from .ranks import with_rank
from .scalars import GraphOf, degrees


def sampled_targets(bc: DataFrame, k: int, seed: int = 0, graph: GraphOf = None) -> DataFrame:
    """k nodes with bc > 0 (of each graph) by a draw on their ids."""
    if graph is not None:
        order = Window.partitionBy("graph").orderBy("u", "node")  # filtered to k, which Spark does before it shuffles
        drawn = bc.filter(F.col("bc") > 0).select("node", graph(F.col("node")).alias("graph"), uniform(key(F.col("node"), seed=seed)).alias("u"))
        return drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(F.col("node").alias("target"))
    return bc.filter(F.col("bc") > 0).orderBy(uniform(key(F.col("node"), seed=seed)), "node").limit(k).select(F.col("node").alias("target"))


def pivot_dataset(edges: DataFrame, bc: DataFrame, k: int = 6, seed: int = 0, graph: GraphOf = None, feats: DataFrame | None = None) -> DataFrame:
    """(target, node, g0 .. g12, y): y = log1p of the node's dependency on the target, for k targets (of each graph)."""
    targets = sampled_targets(bc, k, seed, graph)
    rows = pivot13(edges, targets, graph=graph, feats=feats)
    dep = traverse.dependencies(edges, degrees(edges).select("node"), targets=targets).select(F.col("source").alias("node"), F.col("node").alias("target"), "delta")
    return rows.join(dep, ["target", "node"], "left").withColumn("y", F.log1p(F.coalesce("delta", F.lit(0.0)))).drop("delta")


def share_dataset(edges: DataFrame, bc: DataFrame, targets: int = 25, sources: int = 120, seed: int = 0) -> DataFrame:
    """Six pivot features of up to ``sources`` drawn sources for each target; y is the share of the target's sum."""
    rows = pivot6(edges, sampled_targets(bc, targets, seed))
    order = Window.partitionBy("target").orderBy(uniform(key(F.col("target"), F.col("node"), seed=seed)), "node")
    rows = written(rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= sources).drop("__r"), "share-rows")
    dep = traverse.dependencies(edges, rows.select("node"), targets=rows.select("target")).select(F.col("source").alias("node"), F.col("node").alias("target"), "delta")
    rows = rows.join(dep, ["target", "node"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
    total = F.sum("delta").over(Window.partitionBy("target"))
    return rows.withColumn("__t", total).filter(F.col("__t") > 0).withColumn("y", F.col("delta") / F.col("__t")).drop("__t", "delta")


def drawn_pairs(ranked: DataFrame, k: int, seed: int, lo: tuple[float, float], hi: tuple[float, float], label: int) -> DataFrame:
    """k pairs (i, j) of row numbers, each drawn uniformly from its part (from, to) of the ranked nodes, with replacement.

    Row numbers are drawn and joined, so k rows move and not all pairs.
    """
    spark = ranked.sparkSession
    n = ranked.agg(F.count(F.lit(1)).alias("n"))

    def pick(turn: int, part: tuple[float, float]):
        u = uniform(key(F.col("id"), F.lit(turn), F.lit(label), seed=seed))
        first = F.floor(F.col("n") * part[0])
        return (first + F.floor(u * (F.ceil(F.col("n") * part[1]) - first))).cast("long") + 1

    draws = spark.range(k).join(F.broadcast(n)).filter(F.col("n") > 1).select("id", pick(1, lo).alias("i"), pick(2, hi).alias("j"))
    u = ranked.select(F.col("r").alias("i"), F.col("node").alias("u"), F.col("bc").alias("bc_u"))
    v = ranked.select(F.col("r").alias("j"), F.col("node").alias("v"), F.col("bc").alias("bc_v"))
    return draws.join(u, "i").join(v, "j").select("id", "u", "v", "bc_u", "bc_v")


def ranked_nodes(bc: DataFrame) -> DataFrame:
    """(node, bc, r): nodes with bc > 0 numbered from 1 by (bc, node)."""
    return with_rank(bc.filter(F.col("bc") > 0).select("node", "bc"), "r", [F.col("bc"), F.col("node")])


def _labelled(pairs: DataFrame) -> DataFrame:
    return pairs.filter((F.col("u") != F.col("v")) & (F.col("bc_u") != F.col("bc_v"))).withColumn("y", (F.col("bc_u") > F.col("bc_v")).cast("int"))


def pair_dataset(bc: DataFrame, k: int = 600, seed: int = 0, distinct: bool = True) -> DataFrame:
    """Up to k pairs of differing bc out of 5 k draws; distinct unordered pairs unless told otherwise."""
    pairs = _labelled(drawn_pairs(ranked_nodes(bc), 5 * k, seed, (0, 1), (0, 1), 0))
    if distinct:
        first = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy("id")
        pairs = pairs.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") == 1).drop("__n")
    return pairs.orderBy("id").limit(k)


def stratified_pairs(bc: DataFrame, k: int = 400, seed: int = 0) -> DataFrame:
    """Half uniform pairs, half from the lower third against the upper third of the order by bc."""
    ranked = ranked_nodes(bc)
    uniform_half = _labelled(drawn_pairs(ranked, 5 * k, seed, (0, 1), (0, 1), 1)).orderBy("id").limit(k - k // 2).withColumn("stratum", F.lit("uniform"))
    split = _labelled(drawn_pairs(ranked, 5 * k, seed, (0, 1 / 3), (2 / 3, 1), 2)).orderBy("id").limit(k // 2).withColumn("stratum", F.lit("thirds"))
    return uniform_half.unionByName(split)


def distinguishable_pairs(bc: DataFrame, k: int = 600, least: float = 0.01, seed: int = 0) -> DataFrame:
    """Pairs whose bc differ by at least ``least`` of the greater one."""
    gap = F.abs(F.col("bc_u") - F.col("bc_v")) / F.greatest("bc_u", "bc_v")
    return pair_dataset(bc, 3 * k, seed).filter(gap >= least).orderBy("id").limit(k)


def split(rows: DataFrame, id_column: str, held_out: float = 0.2, seed: int = 0, by: str | None = None) -> DataFrame:
    """``rows`` with part: test for about ``held_out`` of the ids by a draw, exactly that share of each class with ``by``."""
    u = uniform(key(F.col(id_column), seed=seed))
    if by is None:
        return rows.withColumn("part", F.when(u < held_out, "test").otherwise("train"))
    w = Window.partitionBy(by)
    r, n = F.row_number().over(w.orderBy(u, id_column)), F.count(F.lit(1)).over(w)
    return rows.withColumn("part", F.when(r <= F.round(n * held_out), "test").otherwise("train"))


def repeated(rows: DataFrame, times: int = 8) -> DataFrame:
    """Every row ``times`` times, numbered."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation (left as 0 where that is 0)."""
    stats = rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    j = rows.join(F.broadcast(stats))  # one row
    keep = [c for c in rows.columns if c not in columns]
    return j.select(*keep, *[F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(F.lit(0.0)).alias(c) for c in columns])
