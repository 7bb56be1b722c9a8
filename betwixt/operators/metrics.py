"""Ordering efficiency, errors, rank correlations, divergences and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written
from .concordance import concordant, tied
from .ranks import running_total


def efficiency(ordered: DataFrame, by: list[str], ties: str = "skip") -> DataFrame:
    """Share of pairs (bc_u, bc_v, est_u, est_v) that the estimate orders as the exact values do.

    ``ties='skip'`` leaves out pairs of equal exact values; ``'count'`` keeps every trial in the denominator.
    """
    same = (F.col("est_u") > F.col("est_v")) == (F.col("bc_u") > F.col("bc_v"))
    differ = F.col("bc_u") != F.col("bc_v")
    good = F.sum((same & differ).cast("int"))
    total = F.sum(differ.cast("int")) if ties == "skip" else F.count(F.lit(1))
    return ordered.groupBy(*by).agg(F.when(total > 0, good / total).otherwise(F.lit(0.0)).alias("efficiency"))


def average_error(values: DataFrame, by: list[str]) -> DataFrame:
    """Mean of |bc - est| / bc in percent over bc <> 0."""
    return values.filter(F.col("bc") != 0).groupBy(*by).agg(F.avg(F.abs(F.col("bc") - F.col("est")) / F.col("bc") * 100).alias("avg_error"))


def rank_agreement(values: DataFrame, by: list[str], score: str = "score", least: int = 10) -> DataFrame:
    """(by, nodes, pairs, xi, spearman, kendall): xi (over pairs of different exact value), Spearman's rho and Kendall's tau-b, over nodes with bc > 0.

    Fewer than ``least`` nodes give correlations of 0; no differing pair gives xi = 1. A tie of the score counts as "the lower
    id is not greater". Pairs are counted by sorting, over ranges of rows (see ``concordance``).
    """
    rows = values.filter(F.col("bc") > 0).select(*by, "node", F.col("bc").cast("double").alias("bc"), F.col(score).cast("double").alias("s"))
    rows = written(rows, "agreement-rows")
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("nodes"))
    # right where scores are tied: the higher id has the greater value
    lucky = concordant(rows, [*by, "s"], "node", "bc").groupBy(*by).agg(F.sum("ascents").alias("lucky"))
    parts = (
        concordant(rows, by, "bc", "s").withColumnRenamed("ascents", "con"), lucky, tied(rows, by, ["bc"], "tx"), tied(rows, by, ["s"], "ty"), tied(rows, by, ["bc", "s"], "txy"),
        spearman(rows, "bc", "s", by).select(*by, "rho"),
    )
    for x in parts:
        out = out.join(x, by)
    out = out.withColumn("all", F.expr("nodes * (nodes - 1) div 2")).withColumn("pairs", F.col("all") - F.col("tx"))
    dis = F.col("pairs") - F.col("con") - (F.col("ty") - F.col("txy"))
    low = F.sqrt(F.col("pairs").cast("double") * (F.col("all") - F.col("ty")).cast("double"))
    many = F.col("nodes") >= least
    return out.select(
        *by, "nodes", "pairs", F.when(F.col("pairs") > 0, (F.col("con") + F.col("lucky")) / F.col("pairs")).otherwise(F.lit(1.0)).alias("xi"),
        F.when(many, F.col("rho")).otherwise(F.lit(0.0)).alias("spearman"), F.when(many & (low > 0), (F.col("con") - dis) / low).otherwise(F.lit(0.0)).alias("kendall"),
    )


def spearman(values: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, rho) with average ranks of ties; ranks run over distinct values of all groups, less what is before the group."""
    by = by or []

    def ranks(c: str) -> DataFrame:
        counted = values.groupBy(*by, c).agg(F.count(F.lit(1)).alias("k"))
        counted = running_total(counted, "upto", [*(F.col(b) for b in by), F.col(c)], F.col("k"))
        return counted.select(*by, c, (F.col("upto") - F.col("k") + (F.col("k") + 1) / 2).alias(f"r_{c}"))

    # a constant for each group, which correlation does not see
    ranked = values.select(*by, x, y).join(ranks(x), [*by, x]).join(ranks(y), [*by, y])
    if by:
        low = ranked.groupBy(*by).agg(F.min(f"r_{x}").alias("low_x"), F.min(f"r_{y}").alias("low_y"))
        ranked = ranked.join(low, by).withColumn(f"r_{x}", F.col(f"r_{x}") - F.col("low_x")).withColumn(f"r_{y}", F.col(f"r_{y}") - F.col("low_y"))
    rho = F.coalesce(F.nanvl(F.corr(f"r_{x}", f"r_{y}"), F.lit(0.0)), F.lit(0.0))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))


def confidence(predictions: DataFrame) -> DataFrame:
    """One row: pairs, efficiency and the mean probability of the true class, from (prob, label)."""
    right = (F.col("prob") > 0.5) == (F.col("label") == 1)
    true = F.when(F.col("label") == 1, F.col("prob")).otherwise(1 - F.col("prob"))
    return predictions.agg(F.count(F.lit(1)).alias("pairs"), F.avg(right.cast("double")).alias("efficiency"), F.avg(true).alias("avg_confidence"))


def regression_errors(rows: DataFrame) -> DataFrame:
    """One row (mse, mae, r2) of (y, pred)."""
    e = F.col("y") - F.col("pred")
    return rows.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r2"))


def divergence(true: DataFrame, pred: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """(target, kl) of two distributions (target, node, p), each shifted by epsilon and renormalised."""
    both = true.select("target", "node", F.col("p").alias("a")).join(pred.select("target", "node", F.col("p").alias("b")), ["target", "node"], "full")
    w = Window.partitionBy("target")
    a, b = F.coalesce("a", F.lit(0.0)) + epsilon, F.coalesce("b", F.lit(0.0)) + epsilon
    both = both.select("target", (a / F.sum(a).over(w)).alias("a"), (b / F.sum(b).over(w)).alias("b"))
    return both.groupBy("target").agg(F.sum(F.col("a") * F.log(F.col("a") / F.col("b"))).alias("kl"))


def auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row (auc, positives, negatives) by rank sums; equal scores share their mean rank.

    Scores are counted first, so the ranks run over distinct scores.
    """
    by_score = rows.groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    counted = running_total(by_score, "upto", [F.col(score)], F.col("q"))
    parts = counted.select("p", "q", (F.col("p") * (F.col("upto") - F.col("q") / 2)).alias("won"))
    p, q = F.sum("p"), F.sum("q")
    return parts.agg(F.when((p > 0) & (q > 0), F.sum("won") / (p * q)).otherwise(F.lit(0.5)).alias("auc"), p.alias("positives"), q.alias("negatives"))


METRICS = {"efficiency": 4, "spearman": 6, "kendall": 6, "time_ms": 4}


def run_summary(raw: DataFrame) -> DataFrame:
    """dataset, model, runs and the mean and sample deviation of each metric (0 of one run, null of none), rounded."""
    out = [F.count(F.lit(1)).alias("runs")]
    for m, digits in METRICS.items():
        out += [
            F.round(F.avg(m), digits).alias(f"{m}_mean"),
            F.round(F.when(F.count(m) == 1, F.lit(0.0)).otherwise(F.stddev_samp(m)), digits).alias(f"{m}_std"),
        ]
    return raw.groupBy("dataset", "model").agg(*out)


def overall_summary(summary: DataFrame) -> DataFrame:
    """Per model over datasets, from the already rounded means."""
    out = [F.count(F.lit(1)).alias("datasets")]
    for m, name in (("efficiency", "efficiency"), ("spearman", "spearman"), ("kendall", "kendall"), ("time_ms", "time_ms")):
        c = f"{m}_mean"
        digits = METRICS[m]
        out += [
            F.round(F.avg(c) + 1e-9, digits).alias(f"avg_{name}"),  # halves go up, whatever their binary form
            F.round(F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c)), digits).alias(f"std_across_datasets_{name}"),
        ]
    return summary.groupBy("model").agg(*out)


def method_summary(results: DataFrame, baseline: str) -> DataFrame:
    """Per method mean, population deviation, least and greatest xi, and the change against the baseline in points and percent."""
    t = results.groupBy("method").agg(F.avg("xi").alias("mean"), F.stddev_pop("xi").alias("std"), F.min("xi").alias("min"), F.max("xi").alias("max"))
    base = F.broadcast(t.filter(F.col("method") == baseline).select(F.col("mean").alias("__base")))  # one row
    return t.join(base).select(
        "method", "mean", "std", "min", "max", ((F.col("mean") - F.col("__base")) * 100).alias("delta_pp"), ((F.col("mean") / F.col("__base") - 1) * 100).alias("delta_pct")
    )


def improvements(results: DataFrame, baseline: str) -> DataFrame:
    """(graph_id, method, gain): each graph's xi less the baseline's on it."""
    base = results.filter(F.col("method") == baseline).select("graph_id", F.col("xi").alias("__base"))
    return results.filter(F.col("method") != baseline).join(base, "graph_id").select("graph_id", "method", (F.col("xi") - F.col("__base")).alias("gain"))


def trend(results: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least-squares slope and intercept of y on x."""
    return results.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def at_step(sweep: DataFrame, t: int, value: str) -> DataFrame:
    """The sweep's rows at steps = t with the value in percent."""
    return sweep.filter(F.col("steps") == t).withColumn(value, F.col(value) * 100)


def best_checkpoint(epochs: DataFrame, weight: float = 1.0) -> DataFrame:
    """The epoch of the greatest val_acc + 0.3 rho + weight (real_acc + 0.3 real_rho); epochs without evaluation do not count."""
    real = F.coalesce(F.col("real_acc") + 0.3 * F.col("real_rho"), F.lit(0.0))
    score = F.col("val_acc") + 0.3 * F.col("rho") + weight * real
    seen = epochs.filter(F.col("val_acc").isNotNull()).withColumn("score", score)
    return seen.agg(F.max_by("epoch", F.struct("score", -F.col("epoch"))).alias("epoch"), F.max("score").alias("score"))


def scraped(lines: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Named groups of a pattern from text lines (value); lines without a match are left out."""
    return lines.filter(F.col("value").rlike(pattern)).select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])


