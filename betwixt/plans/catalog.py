"""Every query of the graph engine by name, with its DuckDB equivalent.

Values are rounded to six decimals on both sides; whole numbers are 64-bit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import new_folder, written
from ..operators import datasets, estimate, features, forest, generators, harness, metrics, models, networks, perceptron, pivots, scalars, study, traverse
from . import graphs
from .oracle import PAIRS, TARGETS, bfs, contributions, draws, model, query

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
DRAWS, SEED = 50, 7
SEEDS = (11, 23, 37)


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded as a double; negative zero becomes zero."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col.cast("double"), 6) + F.lit(0.0)).alias(name or c)


def r6s(c: str, name: str | None = None) -> str:
    return f"round(({c})::DOUBLE, 6) + 0 AS {name or c}"


def big(c: str, name: str | None = None) -> Column:
    return F.col(c).cast("long").alias(name or c)


def bigs(c: str, name: str | None = None) -> str:
    return f"({c})::BIGINT AS {name or c}"


def register(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return add


def trade_graph(s: SparkSession, d: str) -> DataFrame:
    """Written, as most operators read their edges several times."""
    return written(graphs.trade_graph(s, d), "edges")


def basket_graph(s: SparkSession, d: str) -> DataFrame:
    return written(graphs.basket_graph(s, d), "edges")


def session_graph(s: SparkSession, d: str) -> DataFrame:
    return written(graphs.session_graph(s, d), "edges")


def targets_of(edges: DataFrame) -> DataFrame:
    return scalars.top_degree(edges, TARGETS).select(F.col("node").alias("target"))


# ---------------------------------------------------------------- scalars


@register("edges_canonical", query("trade", ["e"], "SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM e WHERE src < dst"))
def _(s, d):
    return graphs.trade_graph(s, d).filter("src < dst")


@register("degree", query("trade", ["nd"], "SELECT node::BIGINT AS node, deg FROM nd"))
def _(s, d):
    return scalars.degrees(graphs.trade_graph(s, d))


@register("graph_summary", query("trade", ["sc"], f"SELECT n, m, {r6s('avg_deg')}, max_deg FROM sc"))
def _(s, d):
    return scalars.summary(graphs.trade_graph(s, d)).select("n", "m", r6("avg_deg"), "max_deg")


@register("max_degree_node", query("trade", ["nd"], "SELECT node::BIGINT AS node, deg FROM nd ORDER BY deg DESC, node LIMIT 1"))
def _(s, d):
    return scalars.top_degree(graphs.trade_graph(s, d))


@register("degree_hist", query("trade", ["nd"], "SELECT deg, count(*) AS nodes FROM nd GROUP BY 1"))
def _(s, d):
    return scalars.degree_histogram(graphs.trade_graph(s, d))


BASKET_SQL = PAIRS["basket"]


def _spread_labels(k: int) -> str:
    """Labels after k rounds of taking the least label among neighbours, then that label's own label."""
    ctes = [f"e AS MATERIALIZED (SELECT a AS src, b AS dst FROM ({BASKET_SQL}) UNION ALL SELECT b, a FROM ({BASKET_SQL}))", "c0 AS MATERIALIZED (SELECT DISTINCT src AS node, src AS c FROM e)"]
    for i in range(1, k + 1):
        ctes.append(f"m{i} AS MATERIALIZED (SELECT a.node, least(a.c, min(b.c)) AS c FROM c{i - 1} a JOIN e ON e.src = a.node JOIN c{i - 1} b ON b.node = e.dst GROUP BY a.node, a.c)")
        ctes.append(f"c{i} AS MATERIALIZED (SELECT m.node, least(m.c, f.c) AS c FROM m{i} m JOIN m{i} f ON f.node = m.c)")
    ctes.append(f"c AS MATERIALIZED (SELECT x.node, CASE WHEN x.c <> y.c THEN error('more rounds') ELSE x.c END AS component FROM c{k} x JOIN c{k - 1} y USING (node))")
    return "WITH " + ",\n".join(ctes)


@register("components", _spread_labels(8) + "\nSELECT node::BIGINT AS node, component::BIGINT AS component FROM c")
def _(s, d):
    return scalars.connected_components(written(basket_graph(s, d), "edges"))


@register(
    "lcc",
    _spread_labels(8)
    + "\nSELECT src::BIGINT AS src, dst::BIGINT AS dst FROM e WHERE src < dst AND src IN (SELECT node FROM c WHERE component = (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))",
)
def _(s, d):
    return scalars.largest_component(basket_graph(s, d)).filter("src < dst").select("src", "dst")


@register("nonzero_summary", query("trade", ["bc"], f"SELECT {r6s('min(bc) FILTER (WHERE bc > 0)', 'min_bc')}, {r6s('max(bc) FILTER (WHERE bc > 0)', 'max_bc')}, count(*) FILTER (WHERE bc > 0) AS nonzero, count(*) AS n FROM bc"))
def _(s, d):
    return scalars.nonzero_summary(traverse.betweenness(trade_graph(s, d))).select(r6("min_bc"), r6("max_bc"), "nonzero", "n")


TOP_PAIRS = ("pr", "SELECT a.target AS u, b.target AS v FROM tg a JOIN tg b ON a.target < b.target")


def top_pairs(edges: DataFrame) -> DataFrame:
    return estimate.unordered_pairs(targets_of(edges))


@register(
    "common_neighbours",
    query("session", ["tg"], f"SELECT u, v, {bigs('common')}, {r6s('CASE WHEN du + dv - common > 0 THEN common / (du + dv - common)::DOUBLE ELSE 0 END', 'jaccard')} FROM "
          "(SELECT u, v, x.deg AS du, y.deg AS dv, (SELECT count(*) FROM e a JOIN e b ON a.dst = b.dst WHERE a.src = u AND b.src = v) AS common FROM pr JOIN nd x ON x.node = u JOIN nd y ON y.node = v)", [TOP_PAIRS]),
)
def _(s, d):
    e = session_graph(s, d)
    return scalars.common_neighbours(e, top_pairs(e)).select("u", "v", big("common"), r6("jaccard"))


# ---------------------------------------------------------------- traversal


@register("bfs_levels", query("trade", ["bt"], "SELECT source, node, d FROM bt"))
def _(s, d):
    e = trade_graph(s, d)
    return traverse.bfs(e, targets_of(e)).select("source", "node", big("d"))


@register("bfs_sigma", query("trade", ["bt"], f"SELECT source, node, d, {r6s('sigma')} FROM bt"))
def _(s, d):
    e = trade_graph(s, d)
    return traverse.bfs(e, targets_of(e)).select("source", "node", big("d"), r6("sigma"))


@register("bfs_parent", query("trade", ["bt"], "SELECT source, node, parent FROM bt"))
def _(s, d):
    e = trade_graph(s, d)
    return traverse.bfs(e, targets_of(e)).select("source", "node", "parent")


@register("level_stats", query("trade", ["bt"], f"SELECT source, d, count(*) AS size, {r6s('CASE WHEN avg(deg) < 1 THEN 1.01 ELSE avg(deg) END', 'avg_deg')} FROM bt JOIN nd USING (node) GROUP BY 1, 2"))
def _(s, d):
    e = trade_graph(s, d)
    return traverse.level_statistics(traverse.bfs(e, targets_of(e)), scalars.degrees(e)).select("source", big("d"), "size", r6("avg_deg"))


@register("pair_distance", query("trade", ["bt"], "SELECT u, v, least(coalesce(d, 50), 50)::BIGINT AS d FROM pr LEFT JOIN bt ON bt.source = u AND bt.node = v", [TOP_PAIRS]))
def _(s, d):
    e = trade_graph(s, d)
    return traverse.pair_distances(e, top_pairs(e)).select("u", "v", big("d"))


@register("ecc_approx", query("trade", ["ecc"], "SELECT node, ecc::BIGINT AS ecc FROM ecc"))
def _(s, d):
    return traverse.eccentricity_estimate(trade_graph(s, d)).select("node", big("ecc"))


@register("diameter_est", query("trade", ["diam"], "SELECT diameter FROM diam"))
def _(s, d):
    return traverse.diameter_estimate(trade_graph(s, d)).select(big("diameter"))


@register("dependency_single", query("trade", ["da", "tg"], f"SELECT source, node, {r6s('delta')} FROM da WHERE source = (SELECT target FROM tg LIMIT 1)".replace("FROM tg LIMIT 1", "FROM tg JOIN nd ON nd.node = tg.target ORDER BY deg DESC, node LIMIT 1")))
def _(s, d):
    e = trade_graph(s, d)
    return traverse.dependencies(e, scalars.top_degree(e)).select("source", "node", r6("delta"))


@register("exact_bc", query("trade", ["bc"], f"SELECT node, {r6s('bc')} FROM bc"))
def _(s, d):
    return traverse.betweenness(trade_graph(s, d)).select("node", r6("bc"))


@register("optimal_pivots", query("trade", ["opt"], f"SELECT target, node, {r6s('p')} FROM opt"))
def _(s, d):
    e = trade_graph(s, d)
    return traverse.optimal_pivots(e, targets_of(e)).select("target", "node", r6("p"))


# ---------------------------------------------------------------- pivot distributions


def _pivot_query(name: str, model: str, graph: str, build) -> None:
    @register(name, query(graph, [f"p_{model}"], f"SELECT target, node, {r6s('p')} FROM p_{model}"))
    def _(s, d):
        e = build(s, d)
        return pivots.MODELS[model](e, targets_of(e)).select("target", "node", r6("p"))


for _name, _model, _graph in (
    ("eddbm_flat", "flat", "trade"), ("eddbm_level", "level", "trade"), ("eddbm_level_sq", "level_sq", "trade"), ("eddbm_paper", "paper", "trade"),
    ("weddbm", "weddbm", "trade"), ("caeddbm", "caeddbm", "session"), ("pdeddbm", "pdeddbm", "trade"), ("fusion", "fusion", "session"), ("uniform_pivots", "uniform", "trade"),
):
    _pivot_query(_name, _model, _graph, trade_graph if _graph == "trade" else session_graph)


@register(
    "fusion_ml_blend",
    query("trade", ["p_fusion", "opt"], f"SELECT target, node, {r6s('q / sum(q) OVER (PARTITION BY target)', 'p')} FROM (SELECT f.target, f.node, CASE WHEN f.target IN (SELECT target FROM opt) THEN 0.5 * f.p + 0.5 * coalesce(o.p, 0) ELSE f.p END AS q FROM p_fusion0 f LEFT JOIN opt o ON o.target = f.target AND o.node = f.node)"),
)
def _(s, d):
    e = trade_graph(s, d)
    t = targets_of(e)
    return pivots.fusion(e, t, traverse.optimal_pivots(e, t), 0.5).select("target", "node", r6("p"))


@register(
    "smoothed",
    query("trade", ["p_level", "p_uniform"], f"SELECT target, node, {r6s('q / sum(q) OVER (PARTITION BY target)', 'p')} FROM (SELECT u.target, u.node, 0.95::DOUBLE * coalesce(l.p, 0) + 0.05::DOUBLE * u.p AS q FROM p_uniform u LEFT JOIN p_level l ON l.target = u.target AND l.node = u.node)"),
)
def _(s, d):
    e = trade_graph(s, d)
    return pivots.smoothed(e, pivots.eddbm(e, targets_of(e))).select("target", "node", r6("p"))


# ---------------------------------------------------------------- estimates


def drawn(e: DataFrame, model: str = "level", t: int = DRAWS, seed: int = SEED) -> DataFrame:
    return estimate.draw_pivots(pivots.MODELS[model](e, targets_of(e)), t, seed)


def values_of(e: DataFrame) -> DataFrame:
    return written(estimate.contributions(e, drawn(e)), "values")


@register("draws", query("trade", ["draws"], f"SELECT target, t::BIGINT AS t, node, {r6s('p')} FROM dr"))
def _(s, d):
    return drawn(trade_graph(s, d)).select("target", big("t"), "node", r6("p"))


@register("estimate_bc", query("trade", ["est"], f"SELECT target, T::BIGINT AS t, {r6s('est')} FROM est"))
def _(s, d):
    return estimate.estimates(values_of(trade_graph(s, d))).select("target", big("steps", "t"), r6("est"))


@register(
    "estimate_trimmed",
    query("trade", ["values"], f"SELECT target, {r6s('coalesce(avg(value) FILTER (WHERE r > c AND r <= k - c), avg(value)) * 0.5', 'est')} FROM (SELECT *, greatest(1, floor(k * 0.1)) AS c FROM (SELECT target, value, row_number() OVER (PARTITION BY target ORDER BY value, t) AS r, count(*) OVER (PARTITION BY target) AS k FROM va WHERE t <= 25)) GROUP BY 1"),
)
def _(s, d):
    return estimate.trimmed_estimates(values_of(trade_graph(s, d))).select("target", r6("est"))


@register(
    "estimate_adaptive",
    query("trade", ["values"], f"SELECT r.target, {bigs('used')}, {r6s('mean * 0.5', 'est')} FROM rn r JOIN (SELECT target, coalesce(min(t) FILTER (WHERE t >= 5 AND se <= 0.15 * abs(mean)), max(t)) AS used FROM rn GROUP BY 1) a ON a.target = r.target AND a.used = r.t",
          [("rn", "SELECT target, t, avg(value) OVER w AS mean, coalesce(stddev_samp(value) OVER w, 0) / sqrt(t) AS se FROM va WINDOW w AS (PARTITION BY target ORDER BY t ROWS UNBOUNDED PRECEDING)")]),
)
def _(s, d):
    return estimate.adaptive_estimates(values_of(trade_graph(s, d))).select("target", big("used"), r6("est"))


AT25 = "SELECT target, est FROM est WHERE T = 25"


def at25(e: DataFrame) -> DataFrame:
    return estimate.estimates(values_of(e), [25]).select("target", "est")


@register("pair_order", query("trade", ["est"], f"SELECT u, v, {r6s('a.est', 'est_u')}, {r6s('b.est', 'est_v')}, a.est > b.est AS greater FROM pr JOIN ({AT25}) a ON a.target = u JOIN ({AT25}) b ON b.target = v", [TOP_PAIRS]))
def _(s, d):
    e = trade_graph(s, d)
    return estimate.pair_order(at25(e), top_pairs(e), "est").select("u", "v", r6("est_u"), r6("est_v"), "greater")


@register("pair_verdict", query("trade", ["bc", "tg"], f"SELECT u, v, {r6s('a.bc', 'bc_u')}, {r6s('b.bc', 'bc_v')}, CASE WHEN round(a.bc, 6) > round(b.bc, 6) THEN 'A' WHEN round(a.bc, 6) < round(b.bc, 6) THEN 'B' ELSE 'Equal' END AS verdict FROM pr JOIN bc a ON a.node = u JOIN bc b ON b.node = v", [TOP_PAIRS]))
def _(s, d):
    e = trade_graph(s, d)
    bc = traverse.betweenness(e).withColumn("bc", F.round("bc", 6))
    return estimate.verdicts(estimate.pair_order(bc, top_pairs(e), "bc"), "bc").select("u", "v", r6("bc_u"), r6("bc_v"), "verdict")


@register("k_ordering", query("trade", ["est"], f"SELECT target, {r6s('est')}, row_number() OVER (ORDER BY est DESC, target) AS rank FROM ({AT25})"))
def _(s, d):
    return estimate.k_ordering(at25(trade_graph(s, d)), "est").select("target", r6("est"), big("rank"))


# ---------------------------------------------------------------- efficiency


def exact_pairs(e: DataFrame, ordered_too: bool = False) -> DataFrame:
    """Pairs of targets for every sweep entry with exact and estimated values."""
    est = estimate.estimates(values_of(e)).select("target", "steps", "est")
    bc = traverse.betweenness(e).withColumnRenamed("node", "target")
    both = written(est.join(bc, "target"), "both")
    u = both.select(F.col("target").alias("u"), "steps", F.col("est").alias("est_u"), F.round("bc", 6).alias("bc_u"))
    v = both.select(F.col("target").alias("v"), "steps", F.col("est").alias("est_v"), F.round("bc", 6).alias("bc_v"))
    pairs = u.join(v, "steps")  # TARGETS^2 rows for each entry
    return pairs if ordered_too else pairs.filter("u < v")


PAIRS_T = [("bvals", "SELECT est.target, T, est, round(bc, 6) AS bc FROM est JOIN bc ON bc.node = est.target"), ("pt", "SELECT a.T, a.target AS u, b.target AS v, a.est AS est_u, b.est AS est_v, a.bc AS bc_u, b.bc AS bc_v FROM bvals a JOIN bvals b ON a.T = b.T")]
GOOD = "sum(((est_u > est_v) = (bc_u > bc_v) AND bc_u <> bc_v)::INT)"


@register("efficiency_t", query("trade", ["est", "bc"], f"SELECT T::BIGINT AS t, {r6s(f'{GOOD} / nullif(sum((bc_u <> bc_v)::INT), 0)::DOUBLE', 'efficiency')} FROM pt WHERE u < v GROUP BY 1", PAIRS_T))
def _(s, d):
    return metrics.efficiency(exact_pairs(trade_graph(s, d)), ["steps"]).select(big("steps", "t"), r6("efficiency"))


@register("efficiency_legacy", query("trade", ["est", "bc"], f"SELECT T::BIGINT AS t, {r6s(f'{GOOD} / count(*)::DOUBLE', 'efficiency')} FROM pt GROUP BY 1", PAIRS_T))
def _(s, d):
    return metrics.efficiency(exact_pairs(trade_graph(s, d), True), ["steps"], "count").select(big("steps", "t"), r6("efficiency"))


@register("avg_error_t", query("trade", ["est", "bc"], f"SELECT T::BIGINT AS t, {r6s('avg(abs(bc - est) / bc * 100)', 'avg_error')} FROM bvals WHERE bc <> 0 GROUP BY 1", PAIRS_T[:1]))
def _(s, d):
    e = trade_graph(s, d)
    both = estimate.estimates(values_of(e)).join(traverse.betweenness(e).withColumnRenamed("node", "target"), "target").withColumn("bc", F.round("bc", 6))
    return metrics.average_error(both, ["steps"]).select(big("steps", "t"), r6("avg_error"))


@register("prob_compare", query("trade", ["p_level", "opt"], f"SELECT coalesce(l.node, o.node) AS node, {r6s('coalesce(l.p, 0)', 'eddbm')}, {r6s('coalesce(o.p, 0)', 'optimal')} FROM (SELECT * FROM p_level WHERE target = (SELECT node FROM nd ORDER BY deg DESC, node LIMIT 1)) l FULL JOIN (SELECT * FROM opt WHERE target = (SELECT node FROM nd ORDER BY deg DESC, node LIMIT 1)) o ON o.node = l.node"))
def _(s, d):
    e = trade_graph(s, d)
    top = scalars.top_degree(e).select(F.col("node").alias("target"))
    p = pivots.eddbm(e, top).select("node", F.col("p").alias("eddbm"))
    o = traverse.optimal_pivots(e, top).select("node", F.col("p").alias("optimal"))
    return p.join(o, "node", "full").select("node", r6(F.coalesce("eddbm", F.lit(0.0)), "eddbm"), r6(F.coalesce("optimal", F.lit(0.0)), "optimal"))


# ---------------------------------------------------------------- features


@register("clustering", query("session", ["tri"], f"SELECT node, deg, triangles, {r6s('clustering')} FROM cc"))
def _(s, d):
    return features.clustering(session_graph(s, d)).select("node", "deg", "triangles", r6("clustering"))


@register("triangles", query("session", ["tri"], "SELECT node, triangles FROM tri"))
def _(s, d):
    return features.triangles(session_graph(s, d))


@register("kcore", query("session", ["core"], "SELECT node, core::BIGINT AS core FROM core"))
def _(s, d):
    return features.core_numbers(session_graph(s, d)).select("node", big("core"))


NB = "SELECT node, deg, {}, nb_min, nb_max, {}, nb_sum, {}, nb_high FROM nb".format(r6s("nb_avg"), r6s("nb_std"), r6s("inv_sum"))


@register("nbr_stats", query("trade", ["nb"], NB))
def _(s, d):
    return features.neighbour_statistics(trade_graph(s, d)).select("node", "deg", r6("nb_avg"), "nb_min", "nb_max", r6("nb_std"), "nb_sum", r6("inv_sum"), "nb_high")


@register("reach2", query("trade", ["two"], "SELECT node, reach2_paths, reach2_nodes FROM two"))
def _(s, d):
    return features.two_hops(trade_graph(s, d)).select("node", big("reach2_paths"), big("reach2_nodes"))


NODE8A = """SELECT node, {} FROM (SELECT nb.node, nb.deg / max(nb.deg) OVER ()::DOUBLE AS f0, clustering AS f1, core / max(core) OVER ()::DOUBLE AS f2,
nb_avg / (max(nb_avg) OVER () + 1e-9::DOUBLE) AS f3, ln(1 + nb.deg) / ln(2 + max(nb.deg) OVER ()) AS f4, (nb.deg = 1)::INT AS f5, nb.deg / (avg(nb.deg) OVER () + 1e-9::DOUBLE) AS f6, ecc / (count(*) OVER () + 1)::DOUBLE AS f7
FROM nb JOIN cc USING (node) JOIN core USING (node) JOIN ecc USING (node))""".format(", ".join(r6s(f"f{i}") for i in range(8)))


@register("node8a", query("session", ["nb", "tri", "core", "ecc"], NODE8A))
def _(s, d):
    return features.node8a(session_graph(s, d)).select("node", *[r6(f"f{i}") for i in range(8)])


def node8b_sql(reach: str, more: str = "") -> str:
    cols = {
        "log_degree": "ln(1 + nb.deg)", "degree_centrality": "nb.deg / greatest(1, n - 1)::DOUBLE", "log_nb_avg_deg": "ln(1 + nb_avg)", "nb_max_deg_norm": "nb_max / max_deg::DOUBLE",
        "clustering": "clustering", "log_reach2": f"ln(1 + {reach})", "reach2_norm": f"{reach} / greatest(1, n)::DOUBLE", "deg_over_avg": "nb.deg / avg_deg",
    }
    return "SELECT node, " + ", ".join(r6s(v, k) for k, v in cols.items()) + more + " FROM nb JOIN cc USING (node) JOIN two USING (node), sc"


@register("node8b", query("session", ["nb", "tri", "two"], node8b_sql("reach2_paths")))
def _(s, d):
    out = features.node8b(session_graph(s, d))
    return out.select("node", *[r6(c) for c in out.columns if c != "node"])


MORE12 = "".join(", " + r6s(v, k) for k, v in {"nb_cv": "nb_std / greatest(1.0::DOUBLE, nb_avg)", "log_inv_sum": "ln(1 + inv_sum)", "log_nb_sum": "ln(1 + nb_sum)", "log_n": "ln(1 + n)"}.items())


@register("node12", query("session", ["nb", "tri", "two"], node8b_sql("reach2_nodes", MORE12)))
def _(s, d):
    out = features.node12(session_graph(s, d))
    return out.select("node", *[r6(c) for c in out.columns if c != "node"])


F20 = [
    "ln(1 + nb.deg)", "nb.deg / greatest(1, n - 1)::DOUBLE", "ln(1 + nb_avg)", "nb_std / greatest(1.0::DOUBLE, nb_avg)", "ln(1 + nb_max)", "ln(1 + reach2_nodes)", "reach2_nodes / greatest(1, n)::DOUBLE",
    "clustering", "ln(1 + core)", "core / greatest(1, (SELECT max(core) FROM core))::DOUBLE", "ln(1 + triangles)", "ln(1 + avg_deg)", "ln(1 + n)", "ln(1 + diameter)", "nb.deg / greatest(1.0::DOUBLE, avg_deg)",
    "ln(1 + nb.deg * nb_avg)", "nb_min / greatest(1, nb_max)::DOUBLE", "ln(1 + nb_high)", "nb.deg / greatest(1, max_deg)::DOUBLE", "ln(1 + nb_sum)",
]
NODE20 = "SELECT node, " + ", ".join(r6s(x, f"f{i}") for i, x in enumerate(F20, 1)) + " FROM nb JOIN cc USING (node) JOIN core USING (node) JOIN two USING (node), sc, diam"


@register("node20", query("session", ["nb", "tri", "core", "two", "diam"], NODE20))
def _(s, d):
    return features.node20(session_graph(s, d)).select("node", *[r6(f"f{i}") for i in range(1, 21)])


@register("graph_record", query("session", ["sc", "diam", "core", "tri"], f"SELECT n, m, {r6s('avg_deg')}, max_deg, diameter, (SELECT max(core) FROM core)::BIGINT AS max_core, (SELECT count(*) FROM tri3) AS triangles FROM sc, diam"))
def _(s, d):
    return features.graph_record(session_graph(s, d)).select("n", "m", r6("avg_deg"), "max_deg", big("diameter"), big("max_core"), "triangles")


P6 = f"SELECT target, node, d::DOUBLE AS d, {r6s('ln(1 + deg)', 'log_deg')}, {r6s('ln(1 + sigma)', 'log_sigma')}, {r6s('chat')}, {r6s('ln(1 + lev)', 'log_level')}, {r6s('ln(1 + coalesce(dp, 0))', 'log_parent_deg')} FROM p6"
P6_CTE = ("p6", "SELECT c.*, greatest(1.01, avg(c.deg) OVER (PARTITION BY target, d)) AS lev, p.deg AS dp FROM chat c LEFT JOIN nd p ON p.node = c.parent")


@register("pivot6", query("session", ["chat"], P6, [P6_CTE]))
def _(s, d):
    e = session_graph(s, d)
    return features.pivot6(e, targets_of(e)).select("target", "node", "d", r6("log_deg"), r6("log_sigma"), r6("chat"), r6("log_level"), r6("log_parent_deg"))


G13 = [
    "d / (n + 1)::DOUBLE", "pow(greatest(avg_deg, 1.001), -least(d, 20))", "1 / (deg + 1e-9::DOUBLE)", "1 / (dv + 1e-9::DOUBLE)", "deg / (avg_deg + 1e-9::DOUBLE)", "f1", "f2", "1 / (coalesce(sibs, 1) + 1)::DOUBLE",
    "t1", "t2", "(d = 1)::INT", "(d = 2)::INT", "ln(1 + d)",
]
P13_CTES = [
    ("n8", "SELECT cc.node, clustering AS f1, core / max(core) OVER ()::DOUBLE AS f2 FROM cc JOIN core USING (node)"),
    ("sb", "SELECT source, d, count(*) AS sibs FROM bt GROUP BY 1, 2"),
    ("p13", "SELECT x.*, sibs FROM (SELECT tg.target, nd.node, nd.deg, v.deg AS dv, coalesce(bt.d, 999) AS d, a.f1, a.f2, b.f1 AS t1, b.f2 AS t2 FROM nd JOIN tg ON nd.node <> tg.target JOIN nd v ON v.node = tg.target "
            "LEFT JOIN bt ON bt.source = tg.target AND bt.node = nd.node JOIN n8 a ON a.node = nd.node JOIN n8 b ON b.node = tg.target) x LEFT JOIN sb ON sb.source = x.target AND sb.d = x.d"),
]


@register("pivot13", query("session", ["bt", "tri", "core", "sc"], "SELECT target, node, " + ", ".join(r6s(x, f"g{i}") for i, x in enumerate(G13)) + " FROM p13, sc", P13_CTES))
def _(s, d):
    e = session_graph(s, d)
    return features.pivot13(e, targets_of(e)).select("target", "node", *[r6(f"g{i}") for i in range(13)])


N8A_CTE = ("n8a", NODE8A)


@register(
    "pair16",
    query("session", ["nb", "tri", "core", "ecc", "tg"], "SELECT u, v, " + ", ".join(r6s(f"a.f{i} - b.f{i}", f"diff_f{i}") for i in range(8)) + ", " + ", ".join(r6s(f"abs(a.f{i} - b.f{i})", f"abs_f{i}") for i in range(8)) + " FROM pr JOIN n8a a ON a.node = u JOIN n8a b ON b.node = v", [TOP_PAIRS, N8A_CTE]),
)
def _(s, d):
    e = session_graph(s, d)
    feats = features.node8a(e).select("node", *[r6(f"f{i}") for i in range(8)])
    out = features.pair16(feats, top_pairs(e))
    return out.select("u", "v", *[r6(c) for c in out.columns if c not in "uv"])


P45 = [f"a.f{i} AS u_f{i}" for i in range(1, 21)] + [f"b.f{i} AS v_f{i}" for i in range(1, 21)]


@register(
    "pair45",
    query("session", ["nb", "tri", "core", "two", "diam", "bt"], "SELECT u, v, " + ", ".join(P45) + f", {r6s('least(coalesce(bt.d, 50), 50) / greatest(1, diameter)::DOUBLE', 'dist')}, {r6s('ln(1 + common)', 'log_common')}, "
          f"{r6s('common / greatest(1, x.deg + y.deg - common)::DOUBLE', 'jaccard')}, {r6s('abs(x.deg - y.deg) / greatest(1, x.deg, y.deg)::DOUBLE', 'deg_diff')}, (x.deg > y.deg)::INT::DOUBLE AS deg_greater "
          "FROM (SELECT *, (SELECT count(*) FROM e a JOIN e b ON a.dst = b.dst WHERE a.src = u AND b.src = v) AS common FROM pr) q JOIN n20 a ON a.node = u JOIN n20 b ON b.node = v JOIN nd x ON x.node = u JOIN nd y ON y.node = v "
          "LEFT JOIN bt ON bt.source = u AND bt.node = v, diam", [TOP_PAIRS, ("n20", NODE20)]),
)
def _(s, d):
    e = session_graph(s, d)
    out = features.pair45(e, top_pairs(e))
    return out.select("u", "v", *[r6(c) for c in out.columns if c not in "uv"])


@register("norm_adj", query("trade", ["nd"], f"SELECT src, dst, {r6s('1 / sqrt(a.deg::DOUBLE * b.deg)', 'weight')} FROM e JOIN nd a ON a.node = src JOIN nd b ON b.node = dst"))
def _(s, d):
    return features.normalised_adjacency(trade_graph(s, d)).select("src", "dst", r6("weight"))


@register("norm_adj_row", query("trade", ["nd"], f"SELECT src, dst, {r6s('1 / a.deg::DOUBLE', 'weight')} FROM e JOIN nd a ON a.node = src"))
def _(s, d):
    return features.normalised_adjacency(trade_graph(s, d), "row").select("src", "dst", r6("weight"))


# ---------------------------------------------------------------- rank agreement and losses


def scored_nodes(e: DataFrame) -> DataFrame:
    """(node, bc, score): exact values, and the neighbours' degree sum as a ranker."""
    bc = traverse.betweenness(e).withColumn("bc", F.round("bc", 6))
    return written(bc.join(pivots.neighbour_degree_sums(e), "node").withColumn("score", F.log1p("wdeg")), "scored")


SCORED = ("sn", "SELECT bc.node, round(bc, 6) AS bc, ln(1 + wdeg) AS score FROM bc JOIN wd ON wd.node = bc.node")
NONZERO_PAIRS = ("np", "SELECT sign(a.bc - b.bc) AS s, sign(a.score - b.score) AS t FROM sn a JOIN sn b ON a.node < b.node WHERE a.bc > 0 AND b.bc > 0")
XI = "coalesce(avg(((t > 0) = (s > 0))::INT) FILTER (WHERE s <> 0), 1.0)"


@register("xi_exhaustive", query("trade", ["bc", "wd"], f"SELECT 'trade' AS graph, {r6s(XI, 'xi')}, count(*) FILTER (WHERE s <> 0) AS pairs FROM np", [SCORED, NONZERO_PAIRS]))
def _(s, d):
    return metrics.rank_agreement(scored_nodes(trade_graph(s, d)).withColumn("graph", F.lit("trade")), ["graph"]).select("graph", r6("xi"), "pairs")


KENDALL = "sum(s * t) / sqrt(sum((s <> 0)::INT)::DOUBLE * sum((t <> 0)::INT)::DOUBLE)"


@register("kendall", query("trade", ["bc", "wd"], f"SELECT 'trade' AS graph, (SELECT count(*) FROM sn WHERE bc > 0) AS nodes, {r6s(KENDALL, 'kendall')} FROM np", [SCORED, NONZERO_PAIRS]))
def _(s, d):
    return metrics.rank_agreement(scored_nodes(trade_graph(s, d)).withColumn("graph", F.lit("trade")), ["graph"]).select("graph", "nodes", r6("kendall"))


RANKED = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@register("spearman", query("trade", ["bc", "wd"], f"SELECT count(*) AS n, {r6s('corr(rx, ry)', 'rho')} FROM (SELECT ({RANKED.format('bc')})::DOUBLE AS rx, ({RANKED.format('score')})::DOUBLE AS ry FROM sn WHERE bc > 0)", [SCORED]))
def _(s, d):
    return metrics.spearman(scored_nodes(trade_graph(s, d)).filter("bc > 0"), "bc", "score").select("n", r6("rho"))


@register(
    "loss_listwise",
    query("trade", ["bc", "wd"], f"SELECT {r6s('ln(zb) - ab / za', 'cross_entropy')}, {r6s('ln(zb) - ab / za - (ln(za) - aa / za)', 'kl')} FROM (SELECT sum(exp(a)) AS za, sum(exp(b)) AS zb, sum(exp(a) * b) AS ab, sum(exp(a) * a) AS aa FROM (SELECT ln(1 + bc) - max(ln(1 + bc)) OVER () AS a, score - max(score) OVER () AS b FROM sn WHERE bc > 0))", [SCORED]),
)
def _(s, d):
    return models.listwise_loss(scored_nodes(trade_graph(s, d))).select(r6("cross_entropy"), r6("kl"))


@register("loss_regression", query("trade", ["bc", "wd"], f"SELECT {r6s('avg(pow((score - s0) / (s1 - s0 + 1e-8::DOUBLE) - (a - a0) / (a1 - a0), 2))', 'regression_loss')} FROM (SELECT ln(1 + bc) AS a, score, min(ln(1 + bc)) OVER () AS a0, max(ln(1 + bc)) OVER () AS a1, min(score) OVER () AS s0, max(score) OVER () AS s1 FROM sn WHERE bc > 0)", [SCORED]))
def _(s, d):
    return models.scale_loss(scored_nodes(trade_graph(s, d))).select(r6("regression_loss"))


@register("loss_margin", query("trade", ["bc", "wd", "tg"], f"SELECT {r6s('avg(greatest(0, 0.5 - sign(ln(1 + a.bc) - ln(1 + b.bc)) * (a.score - b.score)))', 'margin_loss')} FROM pr JOIN sn a ON a.node = u JOIN sn b ON b.node = v", [TOP_PAIRS, SCORED]))
def _(s, d):
    e = trade_graph(s, d)
    n = scored_nodes(e)
    pairs = estimate.pair_order(n, estimate.pair_order(n, top_pairs(e), "bc").drop("greater"), "score")
    return models.margin_loss(pairs).select(r6("margin_loss"))


@register(
    "kl_by_target",
    query("trade", ["p_level", "opt"], f"SELECT target, {r6s('sum(a * ln(a / b))', 'kl')} FROM (SELECT target, a / sum(a) OVER (PARTITION BY target) AS a, b / sum(b) OVER (PARTITION BY target) AS b FROM (SELECT coalesce(l.target, o.target) AS target, coalesce(o.p, 0) + 1e-12::DOUBLE AS a, coalesce(l.p, 0) + 1e-12::DOUBLE AS b FROM p_level l FULL JOIN opt o ON o.target = l.target AND o.node = l.node)) GROUP BY 1"),
)
def _(s, d):
    e = trade_graph(s, d)
    t = targets_of(e)
    return metrics.divergence(traverse.optimal_pivots(e, t), pivots.eddbm(e, t)).select("target", r6("kl"))


@register("regression_errors", query("trade", ["p_level", "opt"], f"SELECT {r6s('avg((y - q) * (y - q)) * 1e6', 'mse_e6')}, {r6s('avg(abs(y - q))', 'mae')}, {r6s('1 - sum((y - q) * (y - q)) / (var_pop(y) * count(*))', 'r2')} FROM (SELECT l.p AS q, o.p AS y FROM p_level l JOIN opt o ON o.target = l.target AND o.node = l.node)"))
def _(s, d):
    e = trade_graph(s, d)
    t = targets_of(e)
    both = traverse.optimal_pivots(e, t).withColumnRenamed("p", "y").join(pivots.eddbm(e, t).withColumnRenamed("p", "pred"), ["target", "node"])
    return metrics.regression_errors(both).select(r6(F.col("mse") * 1e6, "mse_e6"), r6("mae"), r6("r2"))


@register("auc", query("trade", ["bc", "wd"], f"SELECT {r6s('CASE WHEN p > 0 AND q > 0 THEN (sum(r) FILTER (WHERE y = 1) - p * (p + 1) / 2) / (p * q) ELSE 0.5 END', 'auc')}, p::BIGINT AS positives, q::BIGINT AS negatives FROM (SELECT y, ({RANKED.format('score')})::DOUBLE AS r, sum(y) OVER ()::DOUBLE AS p, sum(1 - y) OVER ()::DOUBLE AS q FROM (SELECT score, (bc > 0)::INT AS y FROM sn)) GROUP BY p, q", [SCORED]))
def _(s, d):
    rows = scored_nodes(trade_graph(s, d)).withColumn("label", (F.col("bc") > 0).cast("int"))
    return metrics.auc(rows).select(r6("auc"), big("positives"), big("negatives"))


CONF = "1 / (1 + exp(-(a.score - b.score)))"


@register("confidence", query("trade", ["bc", "wd", "tg"], f"SELECT count(*) AS pairs, {r6s('avg(((q > 0.5) = (y = 1))::INT)', 'efficiency')}, {r6s('avg(CASE WHEN y = 1 THEN q ELSE 1 - q END)', 'avg_confidence')} FROM (SELECT {CONF} AS q, (a.bc > b.bc)::INT AS y FROM pr JOIN sn a ON a.node = u JOIN sn b ON b.node = v WHERE a.bc <> b.bc)", [TOP_PAIRS, SCORED]))
def _(s, d):
    e = trade_graph(s, d)
    n = scored_nodes(e)
    pairs = estimate.pair_order(n, estimate.pair_order(n, top_pairs(e), "bc").drop("greater"), "score").filter("bc_u <> bc_v")
    pred = pairs.select((1 / (1 + F.exp(-(F.col("score_u") - F.col("score_v"))))).alias("prob"), (F.col("bc_u") > F.col("bc_v")).cast("int").alias("label"))
    return metrics.confidence(pred).select("pairs", r6("efficiency"), r6("avg_confidence"))


# ---------------------------------------------------------------- training sets


BC6 = ("bc6", "SELECT node, round(bc, 6) AS bc FROM bc")
RK = ("rk_", "SELECT node, bc, row_number() OVER (ORDER BY bc, node) AS r FROM bc6 WHERE bc > 0")


def exact(e: DataFrame) -> DataFrame:
    return written(traverse.betweenness(e).withColumn("bc", F.round("bc", 6)), "bc")


def pairs_sql(k: int, label: int, lo: tuple[str, str], hi: tuple[str, str], seed: int = 0) -> str:
    from ..functions.draws import key_sql, uniform_sql

    def pick(turn: int, part: tuple[str, str]) -> str:
        u = uniform_sql(key_sql("id", str(turn), str(label), seed=seed))
        first = f"floor(n * {part[0]})"
        return f"({first} + floor({u} * (ceil(n * {part[1]}) - {first})))::BIGINT + 1"

    return (
        f"SELECT id, a.node AS u, b.node AS v, a.bc AS bc_u, b.bc AS bc_v, (a.bc > b.bc)::INT AS y FROM (SELECT id, {pick(1, lo)} AS i, {pick(2, hi)} AS j FROM (SELECT unnest(range(0, {k})) AS id), (SELECT count(*) AS n FROM rk_)) "
        "JOIN rk_ a ON a.r = i JOIN rk_ b ON b.r = j WHERE a.node <> b.node AND a.bc <> b.bc"
    )


ALL = ("0::DOUBLE", "1::DOUBLE")
PAIR_OUT = f"u, v, {r6s('bc_u')}, {r6s('bc_v')}, y::BIGINT AS y"
DISTINCT_PAIRS = "SELECT * FROM dp QUALIFY row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY id) = 1"


@register("ds_pairs", query("trade", ["bc"], f"SELECT {PAIR_OUT} FROM ({DISTINCT_PAIRS} ORDER BY id LIMIT 600)", [BC6, RK, ("dp", pairs_sql(3000, 0, ALL, ALL))]))
def _(s, d):
    return datasets.pair_dataset(exact(trade_graph(s, d))).select("u", "v", r6("bc_u"), r6("bc_v"), big("y"))


@register("ds_distinguishable", query("trade", ["bc"], f"SELECT {PAIR_OUT} FROM (SELECT * FROM ({DISTINCT_PAIRS} ORDER BY id LIMIT 1800) WHERE abs(bc_u - bc_v) / greatest(bc_u, bc_v) >= 0.01 ORDER BY id LIMIT 600)", [BC6, RK, ("dp", pairs_sql(9000, 0, ALL, ALL))]))
def _(s, d):
    return datasets.distinguishable_pairs(exact(trade_graph(s, d))).select("u", "v", r6("bc_u"), r6("bc_v"), big("y"))


THIRDS = (("0::DOUBLE", "(1 / 3::DOUBLE)"), ("(2 / 3::DOUBLE)", "1::DOUBLE"))


@register("ds_stratified", query("trade", ["bc"], f"SELECT {PAIR_OUT}, 'uniform' AS stratum FROM (SELECT * FROM du ORDER BY id LIMIT 200) UNION ALL SELECT {PAIR_OUT}, 'thirds' FROM (SELECT * FROM dt3 ORDER BY id LIMIT 200)",
                                 [BC6, RK, ("du", pairs_sql(2000, 1, ALL, ALL)), ("dt3", pairs_sql(2000, 2, *THIRDS))]))
def _(s, d):
    return datasets.stratified_pairs(exact(trade_graph(s, d))).select("u", "v", r6("bc_u"), r6("bc_v"), big("y"), "stratum")


def _sampled(k: int) -> tuple[str, str]:
    from ..functions.draws import key_sql, uniform_sql

    return ("tg", f"SELECT node AS target FROM bc6 WHERE bc > 0 ORDER BY {uniform_sql(key_sql('node', seed=0))}, node LIMIT {k}")


@register("ds_share_targets", query("trade", ["bc"], "SELECT target FROM tg", [BC6, _sampled(25)]))
def _(s, d):
    return datasets.sampled_targets(exact(trade_graph(s, d)), 25)


PIVOT_Y = "LEFT JOIN da ON da.source = p13.node AND da.node = p13.target, sc"


@register(
    "ds_pivot",
    query("session", ["bt", "tri", "core", "sc", "da"], "SELECT target, p13.node, " + ", ".join(r6s(x, f"g{i}") for i, x in enumerate(x.replace("(d =", "(p13.d =") for x in G13)) + f", {r6s('ln(1 + coalesce(delta, 0))', 'y')} FROM p13 {PIVOT_Y}", P13_CTES, [BC6, _sampled(6)]),
)
def _(s, d):
    e = session_graph(s, d)
    out = datasets.pivot_dataset(e, exact(e))
    return out.select("target", "node", *[r6(c) for c in out.columns if c not in ("target", "node")])


def _share_ctes() -> list[tuple[str, str]]:
    from ..functions.draws import key_sql, uniform_sql

    u = uniform_sql(key_sql("target", "node", seed=0))
    return [
        P6_CTE,
        ("drawn", f"SELECT * FROM p6 QUALIFY row_number() OVER (PARTITION BY target ORDER BY {u}, node) <= 120"),
        ("shares", "SELECT p.*, coalesce(da.delta, 0) AS own, sum(coalesce(da.delta, 0)) OVER (PARTITION BY target) AS total FROM drawn p LEFT JOIN da ON da.source = p.node AND da.node = p.target"),
    ]


@register("ds_share", query("session", ["chat", "da"], P6.replace(" FROM p6", f", {r6s('own / total', 'y')} FROM shares WHERE total > 0"), _share_ctes(), [BC6, _sampled(25)]))
def _(s, d):
    e = session_graph(s, d)
    out = datasets.share_dataset(e, exact(e))
    return out.select("target", "node", *[r6(c) for c in out.columns if c not in ("target", "node")])


def _split_sql() -> str:
    from ..functions.draws import key_sql, uniform_sql

    return f"SELECT node, CASE WHEN {uniform_sql(key_sql('node', seed=0))} < 0.2::DOUBLE THEN 'test' ELSE 'train' END AS part FROM nd"


@register("split", query("trade", ["nd"], _split_sql()))
def _(s, d):
    return datasets.split(scalars.degrees(trade_graph(s, d)).select("node"), "node")


@register("standardise", query("trade", ["nb"], "SELECT node, {} FROM nb".format(", ".join(r6s(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", c) for c in ("deg", "nb_avg", "nb_sum")))))
def _(s, d):
    out = datasets.standardised(features.neighbour_statistics(trade_graph(s, d)).select("node", "deg", "nb_avg", "nb_sum"), ["deg", "nb_avg", "nb_sum"])
    return out.select("node", r6("deg"), r6("nb_avg"), r6("nb_sum"))


# ---------------------------------------------------------------- many graphs at once


GRAPH = "(node // 1099511627776)"
FOREST_PAIRS, FOREST_T = 60, 25


def month_edges(s: SparkSession, d: str) -> DataFrame:
    """One way of each edge is written."""
    half = written(forest.merged(graphs.month_pairs(s, d).select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"))), "edges")
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def with_graph(rows: DataFrame) -> DataFrame:
    return rows.withColumn("graph_id", forest.graph_of(F.col("node"))).withColumn("node", forest.node_of(F.col("node")))


@register("forest_bc", query("months", ["bc"], f"SELECT {GRAPH} AS graph_id, node % 1099511627776 AS node, {r6s('bc')} FROM bc"))
def _(s, d):
    """Exact values of every month's trade graph."""
    return with_graph(forest.exact_values(month_edges(s, d))).select("graph_id", "node", r6("bc"))


FOREST8A = f"""SELECT {GRAPH} AS graph_id, node % 1099511627776 AS node, {{}} FROM (SELECT nb.node, nb.deg / max(nb.deg) OVER g::DOUBLE AS f0, clustering AS f1, core / max(core) OVER g::DOUBLE AS f2,
nb_avg / (max(nb_avg) OVER g + 1e-9::DOUBLE) AS f3, ln(1 + nb.deg) / ln(2 + max(nb.deg) OVER g) AS f4, (nb.deg = 1)::INT AS f5, nb.deg / (avg(nb.deg) OVER g + 1e-9::DOUBLE) AS f6, gecc / (count(*) OVER g + 1)::DOUBLE AS f7
FROM nb JOIN cc USING (node) JOIN core USING (node) JOIN gecc USING (node) WINDOW g AS (PARTITION BY nb.node // 1099511627776))""".format(", ".join(r6s(f"f{i}") for i in range(8)))
FOREST_ECC = [
    ("ga", f"SELECT node AS s, {GRAPH} AS g FROM nd QUALIFY row_number() OVER (PARTITION BY {GRAPH} ORDER BY node) <= 5"),
    *bfs("bg", "SELECT s FROM ga"),
    ("gn", f"SELECT {GRAPH} AS g, count(*) AS n, avg(deg) AS avg_deg FROM nd GROUP BY 1"),
    ("gecc", f"SELECT nd.node, CASE WHEN met = least(n, 5) THEN far ELSE n END AS gecc FROM nd JOIN gn ON gn.g = nd.node // 1099511627776 LEFT JOIN (SELECT node, max(d) AS far, count(*) AS met FROM bg GROUP BY 1) q ON q.node = nd.node"),
]


@register("forest_node8a", query("months", ["nb", "tri", "core"], FOREST8A, FOREST_ECC))
def _(s, d):
    """The eight node features of every month's trade graph, relative to the graph."""
    return with_graph(features.node8a(month_edges(s, d), graph=forest.graph_of)).select("graph_id", "node", *[r6(f"f{i}") for i in range(8)])


def _forest_pairs_sql(k: int, label: int) -> list[tuple[str, str]]:
    from ..functions.draws import key_sql, uniform_sql

    def pick(turn: int) -> str:
        return f"floor({uniform_sql(key_sql('g', 'id', str(turn), str(label), seed=0))} * n)::BIGINT + 1"

    return [
        ("bc6", "SELECT node, round(bc, 6) AS bc FROM bc"),
        ("frk", f"SELECT node, bc, {GRAPH} AS g, row_number() OVER (PARTITION BY {GRAPH} ORDER BY bc, node) AS r FROM bc6 WHERE bc > 0"),
        ("fdr", f"SELECT g, id, {pick(1)} AS i, {pick(2)} AS j FROM (SELECT g, count(*) AS n FROM frk GROUP BY 1 HAVING count(*) > 1), (SELECT unnest(range(0, {k}))::INTEGER AS id)"),
        ("fpr", "SELECT d.g, id, a.node AS u, b.node AS v, a.bc AS bc_u, b.bc AS bc_v FROM fdr d JOIN frk a ON a.g = d.g AND a.r = d.i JOIN frk b ON b.g = d.g AND b.r = d.j WHERE a.node <> b.node AND a.bc <> b.bc "
                "QUALIFY row_number() OVER (PARTITION BY least(a.node, b.node), greatest(a.node, b.node) ORDER BY id) = 1"),
    ]


FOREST_XI = [
    ("tg", "SELECT u AS target FROM fpr UNION SELECT v FROM fpr"),
    *bfs("bt", "SELECT target AS s FROM tg"),
    ("gn", f"SELECT {GRAPH} AS g, avg(deg) AS avg_deg FROM nd GROUP BY 1"),
    ("cl", "SELECT b.source AS target, b.node, b.d, nd.deg, greatest(avg_deg, 1.001) AS lam FROM bt b JOIN nd ON nd.node = b.node JOIN gn ON gn.g = b.node // 1099511627776 WHERE b.d > 0"),
    ("pf", model("level_sq")),
    *draws("fd", "pf", FOREST_T, 0),
    *contributions("fv", "fd"),
    ("fe", f"SELECT target, sum(value) / {FOREST_T} * 0.5::DOUBLE AS est FROM fv GROUP BY 1"),
]


@register("forest_xi", query("months", ["bc"], f"SELECT g AS graph_id, 'baseline' AS method, count(*) AS pairs, {r6s('avg(((coalesce(a.est, 0) > coalesce(b.est, 0)) = (bc_u > bc_v))::INT)', 'xi')} FROM fpr LEFT JOIN fe a ON a.target = u LEFT JOIN fe b ON b.target = v GROUP BY g",
                             [*_forest_pairs_sql(FOREST_PAIRS, 0), *FOREST_XI]))
def _(s, d):
    """The baseline's share of rightly ordered pairs in every month's trade graph: 25 pivots for each node of drawn pairs."""
    e = month_edges(s, d)
    bc = written(forest.exact_values(e).withColumn("bc", F.round("bc", 6)), "bc")
    pairs = written(forest.drawn_pairs(bc, FOREST_PAIRS), "pairs")
    est = forest.sampled_estimates(e, pairs.select("u").union(pairs.select("v")), FOREST_T)
    return forest.agreement(forest.ordered(pairs, est, "est"), "baseline").select("graph_id", "method", "pairs", r6("xi"))


# ---------------------------------------------------------------- models (no SQL form)


GBT = {"trees": 60, "rate": 0.15}  # pyspark.ml's trees; the published runs take 250 and 300 at 0.05


def pivot_rows(s: SparkSession, d: str) -> DataFrame:
    """(target, node, part, g0 .. g12, y) of the trade graph; a fifth of the nodes held out."""
    e = trade_graph(s, d)
    return written(datasets.split(datasets.pivot_dataset(e, exact(e)), "node"), "pivot-rows")


def _pivot_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    p = pivots.from_scores(scores.select("target", "node", "score"), "score")
    return p.join(scores, ["target", "node"]).select("target", "node", "part", r6("y"), r6("score"), r6("p"))


@register("model_pivot_gbt")
def _(s, d):
    """Model A on the trade graph: boosted trees fitted on four fifths of the nodes; scores of all, as probabilities too."""
    rows = pivot_rows(s, d)
    fit = models.pivot_regressor(study.G13, **GBT).fit(rows.filter("part = 'train'"))
    scores = written(fit.transform(rows).select("target", "node", "part", "y", F.col("prediction").alias("score")), "scores")
    return _pivot_scores(rows, scores)


@register("model_pivot_mlp")
def _(s, d):
    """The small regression perceptron on the same rows."""
    rows = pivot_rows(s, d)
    fit = perceptron.Perceptron().fit(rows.filter("part = 'train'"), study.G13, "y")
    scores = written(fit.transform(rows, study.G13, "score").select("target", "node", "part", "y", "score"), "scores")
    return _pivot_scores(rows, scores)


@register("model_pair_gbt")
def _(s, d):
    """Model B on the trade graph: boosted trees on differences of the eight node features; 15 % of the pairs held out."""
    e = trade_graph(s, d)
    pairs = written(datasets.split(datasets.pair_dataset(exact(e)).withColumn("id", F.xxhash64("u", "v")), "id", 0.15).drop("id"), "pairs")
    rows = features.pair16(written(features.node8a(e), "node8"), pairs.select("u", "v")).join(pairs.select("u", "v", "y", "part"), ["u", "v"])
    rows = written(rows, "pair-rows")
    cols = [c for c in rows.columns if c not in ("u", "v", "y", "part")]
    fit = models.pair_classifier(cols, **GBT).fit(rows.filter("part = 'train'"))
    return models.pair_probabilities(fit, rows).select("u", "v", "part", big("y"), r6("prob"))


@register("model_vote")
def _(s, d):
    """Trees and a perceptron on pairs of all month graphs, weighted by their out-of-fold AUC; probabilities of the held-out graphs' pairs."""
    one = study.Study(month_edges(s, d), pairs=FOREST_PAIRS)
    rows = written(one.pair_rows(FOREST_PAIRS), "vote-rows")
    cols = [c for c in rows.columns if c not in ("u", "v", "y")]
    vote = models.SoftVote(cols, trees=20, depth=5, hidden=(32, 16), epochs=60).weighted(rows, F.col("u"))
    test = features.pair16(one.feats, one.pairs.select("u", "v")).join(one.pairs.select("u", "v", (F.col("bc_u") > F.col("bc_v")).cast("int").alias("y")), ["u", "v"])
    return vote.transform(test).select("u", "v", big("y"), r6("prob"), F.lit(vote.weights[0]).alias("trees_weight"))


@register("study_xi")
def _(s, d):
    """The study over every month's trade graph: the baseline at 25 pivots and models A, B and C, scored on held-out months."""
    one = study.Study(month_edges(s, d), pairs=FOREST_PAIRS)
    out = one.baseline()
    for x in (one.model_a(**GBT), one.model_b(**GBT), one.model_c(new_folder(s, "study"))):
        out = out.unionByName(x)
    return out.select("graph_id", "method", "pairs", r6("xi"))


def _network(s: SparkSession, d: str, plan: networks.Plan) -> tuple[DataFrame, networks.State, DataFrame]:
    rows = study.Study(month_edges(s, d), pairs=FOREST_PAIRS).packed()
    state, table = networks.train(rows, plan, new_folder(s, "network"))
    return rows, state, table


@register("network_sage")
def _(s, d):
    """The three-layer network with residuals on every month's graph, best of all its epochs: pairs rightly ordered and Spearman's rho by graph."""
    rows, state, _ = _network(s, d, networks.SAGE)
    return networks.graph_metrics(rows, networks.SAGE, state.weights).select("graph_id", "part", "correct", "pairs", r6("rho"))


@register("network_gcn")
def _(s, d):
    """The five-layer network of four heads, best of all its epochs, through two restarts of its rate."""
    rows, state, _ = _network(s, d, networks.GCN)
    return networks.graph_metrics(rows, networks.GCN, state.weights).select("graph_id", "part", "correct", "pairs", r6("rho"))


@register("network_epochs")
def _(s, d):
    """Loss and held-out metrics by epoch of a narrow network of heads, and which epoch's weights are selected."""
    _, _, table = _network(s, d, replace(networks.GCN, width=32, layers=2, heads=2, head=(16,), epochs=8, steps=2, every=1))
    best = networks.selected(table)
    return table.select("epoch", r6("loss"), r6("train_acc"), r6("val_acc"), r6("rho"), r6("rate"), (F.col("epoch") == best).alias("selected"))


SAGE_W = (np.array([[0.5, -0.25], [0.25, 0.75]]), np.array([[1.0, 0.5], [-0.5, 0.25]]), np.array([0.1, -0.1]))


def _sage_sql() -> str:
    ws, wn, b = SAGE_W
    z = [" + ".join([f"{ws[i, j]}::DOUBLE * h{i}" for i in range(2)] + [f"{wn[i, j]}::DOUBLE * m{i}" for i in range(2)] + [f"({b[j]}::DOUBLE)"]) for j in range(2)]
    return (
        f"SELECT node, {r6s('a0 / greatest(sqrt(a0 * a0 + a1 * a1), 1e-9)', 'z0')}, {r6s('a1 / greatest(sqrt(a0 * a0 + a1 * a1), 1e-9)', 'z1')} FROM "
        f"(SELECT node, greatest({z[0]}, 0) AS a0, greatest({z[1]}, 0) AS a1 FROM (SELECT hh.*, coalesce(m0, h0) AS m0, coalesce(m1, h1) AS m1 FROM hh LEFT JOIN (SELECT e.src AS node, avg(h0) AS m0, avg(h1) AS m1 FROM e JOIN hh x ON x.node = e.dst GROUP BY 1) m USING (node)))"
    )


@register("sage_layer", query("trade", ["nb", "sc"], _sage_sql(), [("hh", "SELECT node, ln(1 + deg) AS h0, deg / avg_deg AS h1 FROM nd, sc")]))
def _(s, d):
    e = trade_graph(s, d)
    h = scalars.degrees(e).join(F.broadcast(scalars.summary(e).select("avg_deg"))).select("node", F.array(F.log1p("deg"), F.col("deg") / F.col("avg_deg")).alias("h"))
    return models.sage_layer(e, h, *SAGE_W).select("node", r6(F.col("h")[0], "z0"), r6(F.col("h")[1], "z1"))


@register("generated_graphs")
def _(s, d):
    """Two random graphs for each month's trade graph, of as many nodes and about as many edges: equally likely edges, and preferential attachment."""
    e = graphs.month_graphs(s, d)
    size = e.groupBy("graph_id").agg(F.countDistinct("src").cast("int").alias("n"), (F.count(F.lit(1)) / 2).alias("m"))
    both = size.select("*", F.explode(F.array(F.lit("er"), F.lit("ba"))).alias("kind"))
    param = F.when(F.col("kind") == "er", 2 * F.col("m") / (F.col("n") * (F.col("n") - 1.0))).otherwise(F.greatest(F.lit(1.0), F.round(F.col("m") / F.col("n"))))
    catalogue = both.select((F.col("graph_id") * 2 + (F.col("kind") == "ba").cast("int")).alias("graph_id"), "kind", "n", param.alias("param"), F.lit(42).cast("long").alias("seed"))
    made = forest.largest_components(generators.generate(catalogue))
    return made.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("nodes"))


# ---------------------------------------------------------------- roll-ups


RUN_MODELS = ("flat", "level", "paper")


def raw_runs(s: SparkSession, d: str) -> DataFrame:
    """A row for each model, seed and data set (customers, suppliers): agreement of the estimate at T = 25 over targets."""
    e = trade_graph(s, d)
    bc = exact(e)
    alls = None
    for seed in SEEDS:
        part = harness.evaluated(e, bc, targets_of(e), list(RUN_MODELS), 25, seed).withColumn("seed", F.lit(seed))
        alls = part if alls is None else alls.unionByName(part)
    alls = alls.withColumnRenamed("method", "model").withColumn("dataset", F.when(F.col("target") % 2 == 0, "customers").otherwise("suppliers"))
    rows = written(alls, "runs")
    keys = ["dataset", "model", "seed"]
    eff = metrics.efficiency(harness.target_pairs(rows, keys), keys)
    work = rows.groupBy(*keys).agg(F.sum("pivots").cast("double").alias("time_ms"))
    return work.join(eff, keys, "left").select(*keys, F.round("efficiency", 6).alias("efficiency"), F.lit(None).cast("double").alias("spearman"), F.lit(None).cast("double").alias("kendall"), "time_ms")


def _runs_ctes() -> list[tuple[str, str]]:
    out, union = [], []
    for m in RUN_MODELS:
        for seed in SEEDS:
            n = f"q_{m}_{seed}"
            out += draws(n, f"p_{m}", 25, seed) + contributions(f"{n}_v", n)
            union.append(f"SELECT '{m}' AS model, {seed} AS seed, target, sum(value) / 25 * 0.5::DOUBLE AS est, count(DISTINCT node) AS pivots FROM {n}_v GROUP BY target")
    out.append(("runs0", " UNION ALL ".join(union)))
    out.append(("runs1", "SELECT runs0.*, round(bc, 6) AS bc, CASE WHEN target % 2 = 0 THEN 'customers' ELSE 'suppliers' END AS dataset FROM runs0 JOIN bc ON bc.node = target"))
    good = "sum(((a.est > b.est) = (a.bc > b.bc) AND a.bc <> b.bc)::INT)"
    out.append(("eff", f"SELECT dataset, model, seed, CASE WHEN sum((a.bc <> b.bc)::INT) > 0 THEN {good} / sum((a.bc <> b.bc)::INT)::DOUBLE ELSE 0 END AS efficiency FROM runs1 a JOIN runs1 b USING (dataset, model, seed) WHERE a.target < b.target GROUP BY 1, 2, 3"))
    out.append(("runs", "SELECT w.*, round(efficiency, 6) AS efficiency, NULL::DOUBLE AS spearman, NULL::DOUBLE AS kendall FROM (SELECT dataset, model, seed, sum(pivots)::DOUBLE AS time_ms FROM runs1 GROUP BY 1, 2, 3) w LEFT JOIN eff USING (dataset, model, seed)"))
    return out


def _summary_sql() -> str:
    cols = ["count(*) AS runs"]
    for m, digits in metrics.METRICS.items():
        cols += [f"round(avg({m}), {digits}) AS {m}_mean", f"round(CASE WHEN count({m}) = 1 THEN 0 ELSE stddev_samp({m}) END, {digits}) AS {m}_std"]
    return "SELECT dataset, model, " + ", ".join(cols) + " FROM runs GROUP BY 1, 2"


RUN_NEEDS = ["p_flat", "p_level", "p_paper", "da", "bc"]


@register("multirun_summary", query("trade", RUN_NEEDS, _summary_sql(), _runs_ctes()))
def _(s, d):
    return metrics.run_summary(raw_runs(s, d))


def _overall_sql() -> str:
    cols = ["count(*) AS datasets"]
    for m, digits in metrics.METRICS.items():
        c = f"{m}_mean"
        cols += [f"round(avg({c}) + 1e-9, {digits}) AS avg_{m}", f"round(CASE WHEN count({c}) = 1 THEN 0 ELSE stddev_samp({c}) END, {digits}) AS std_across_datasets_{m}"]
    return "SELECT model, " + ", ".join(cols) + f" FROM ({_summary_sql()}) GROUP BY 1"


@register("multirun_overall", query("trade", RUN_NEEDS, _overall_sql(), _runs_ctes()))
def _(s, d):
    return metrics.overall_summary(written(metrics.run_summary(raw_runs(s, d)), "summary"))


BENCH_MODELS = ["flat", "level", "paper", "weddbm", "pdeddbm", "uniform"]


def _benchmark_sql() -> str:
    ctes, union = [], []
    for m in BENCH_MODELS:
        ctes += draws(f"b_{m}", f"p_{m}", 25, SEED) + contributions(f"b_{m}_v", f"b_{m}")
        union.append(f"SELECT '{m}' AS method, target, sum(value) / 25 * 0.5::DOUBLE AS est FROM b_{m}_v GROUP BY target")
    ctes += draws("b_ad", "p_fusion", 75, SEED) + contributions("b_ad_v", "b_ad")
    ctes.append(("b_rn", "SELECT target, t, avg(value) OVER w AS mean, coalesce(stddev_samp(value) OVER w, 0) / sqrt(t) AS se FROM b_ad_v WINDOW w AS (PARTITION BY target ORDER BY t ROWS UNBOUNDED PRECEDING)"))
    ctes.append(("b_st", "SELECT target, coalesce(min(t) FILTER (WHERE t >= 5 AND se <= 0.15 * abs(mean)), max(t)) AS used FROM b_rn GROUP BY 1"))
    union.append("SELECT 'adaptive', r.target, mean * 0.5::DOUBLE FROM b_rn r JOIN b_st s ON s.target = r.target AND s.used = r.t")
    ctes.append(("b_all", "SELECT u.*, round(bc, 6) AS bc FROM (" + " UNION ALL ".join(union) + ") u JOIN bc ON bc.node = u.target"))
    good = "sum(((a.est > b.est) = (a.bc > b.bc) AND a.bc <> b.bc)::INT)"
    final = (
        f"SELECT x.method, (CASE WHEN x.method = 'adaptive' THEN (SELECT max(used) FROM b_st) ELSE 25 END)::BIGINT AS t, {r6s('efficiency')}, {r6s('avg_error')} FROM "
        f"(SELECT method, {good} / nullif(sum((a.bc <> b.bc)::INT), 0)::DOUBLE AS efficiency FROM b_all a JOIN b_all b USING (method) WHERE a.target < b.target GROUP BY 1) x "
        "JOIN (SELECT method, avg(abs(bc - est) / bc * 100) AS avg_error FROM b_all WHERE bc <> 0 GROUP BY 1) y ON y.method = x.method"
    )
    return query("trade", [f"p_{m}" for m in BENCH_MODELS] + ["p_fusion", "da", "bc"], final, ctes)


@register("benchmark_models", _benchmark_sql())
def _(s, d):
    e = trade_graph(s, d)
    return harness.benchmark(e, exact(e), targets_of(e), BENCH_MODELS, 25, SEED).select("method", "t", r6("efficiency"), r6("avg_error"))


def method_results(s: SparkSession, d: str) -> DataFrame:
    """(graph_id, method, xi): one row for each seed's draws of a model over both data sets."""
    return written(raw_runs(s, d).select(F.concat_ws("-", "dataset", F.col("seed").cast("string")).alias("graph_id"), F.col("model").alias("method"), F.coalesce("efficiency", F.lit(1.0)).alias("xi")), "methods")


RES = ("res", "SELECT dataset || '-' || seed::VARCHAR AS graph_id, model AS method, coalesce(efficiency, 1.0) AS xi FROM runs")
METHODS = "SELECT method, avg(xi) AS mean, stddev_pop(xi) AS std, min(xi) AS min, max(xi) AS max FROM res GROUP BY 1"


@register("method_summary", query("trade", RUN_NEEDS, f"SELECT t.method, {r6s('t.mean', 'mean')}, {r6s('t.std', 'std')}, {r6s('t.min', 'min')}, {r6s('t.max', 'max')}, {r6s('(t.mean - b.mean) * 100', 'delta_pp')}, {r6s('(t.mean / b.mean - 1) * 100', 'delta_pct')} FROM ({METHODS}) t, ({METHODS}) b WHERE b.method = 'flat'", [*_runs_ctes(), RES]))
def _(s, d):
    return metrics.method_summary(method_results(s, d), "flat").select("method", *[r6(c) for c in ("mean", "std", "min", "max", "delta_pp", "delta_pct")])


@register("improvement", query("trade", RUN_NEEDS, f"SELECT a.graph_id, a.method, {r6s('a.xi - b.xi', 'gain')} FROM res a JOIN res b USING (graph_id) WHERE b.method = 'flat' AND a.method <> 'flat'", [*_runs_ctes(), RES]))
def _(s, d):
    return metrics.improvements(method_results(s, d), "flat").select("graph_id", "method", r6("gain"))


EFF_T = ("et", f"SELECT T, round(({GOOD} / nullif(sum((bc_u <> bc_v)::INT), 0)::DOUBLE), 6) AS efficiency FROM pt WHERE u < v GROUP BY 1")


@register("trend", query("trade", ["est", "bc"], f"SELECT 'level' AS model, {r6s('regr_slope(efficiency, T)', 'slope')}, {r6s('regr_intercept(efficiency, T)', 'intercept')} FROM et", [*PAIRS_T, EFF_T]))
def _(s, d):
    sweep = metrics.efficiency(exact_pairs(trade_graph(s, d)), ["steps"]).withColumn("efficiency", F.round("efficiency", 6)).withColumn("model", F.lit("level"))
    return metrics.trend(sweep, "steps", "efficiency", ["model"]).select("model", r6("slope"), r6("intercept"))


@register("at_t25", query("trade", ["est", "bc"], f"SELECT T::BIGINT AS t, {r6s('efficiency * 100', 'efficiency')} FROM et WHERE T = 25", [*PAIRS_T, EFF_T]))
def _(s, d):
    sweep = metrics.efficiency(exact_pairs(trade_graph(s, d)), ["steps"]).withColumn("efficiency", F.round("efficiency", 6))
    return metrics.at_step(sweep, 25, "efficiency").select(big("steps", "t"), r6("efficiency"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


