"""DuckDB SQL of the graph queries, assembled from common table expressions.

Traversals are unrolled to ``LEVELS`` levels. The last level must be empty, else a guard raises an error.
"""

from __future__ import annotations

from ..functions.draws import key_sql, uniform_sql

LEVELS = 16
TARGETS = 20

PAIRS = {
    "trade": "SELECT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) >= 2",
    "basket": "SELECT DISTINCT o_custkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    # graph_id << 40 | node, as in ``forest.merged``
    "months": (
        "SELECT DISTINCT g * 1099511627776 + o_custkey * 2 AS a, g * 1099511627776 + l_suppkey * 2 + 1 AS b FROM lineitem JOIN (SELECT *, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS g FROM orders) ON l_orderkey = o_orderkey"
    ),
    "session": (
        "SELECT least(user_id, nxt) AS a, greatest(user_id, nxt) AS b FROM "
        "(SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt <> user_id GROUP BY 1, 2 HAVING count(*) >= 2"
    ),
}


def bfs(name: str, sources: str) -> list[tuple[str, str]]:
    """CTEs <name> (source, node, d, sigma, parent) from ``sources`` (SQL with a column s), and one for each level."""
    out = [(f"{name}0", f"SELECT s AS source, s AS node, 1.0::DOUBLE AS sigma, NULL::BIGINT AS parent, 1::BIGINT AS rk FROM ({sources})")]
    for k in range(1, LEVELS + 1):
        seen = "".join(
            f" AND NOT EXISTS (SELECT 1 FROM {name}{j} p WHERE p.source = a.source AND p.node = e.dst)" for j in (k - 1, k - 2) if j >= 0
        )
        guard = " , CASE WHEN count(*) OVER () > 0 THEN error('more levels') END AS stop" if k == LEVELS else ""
        out.append((
            f"{name}{k}",
            f"SELECT source, node, sigma, parent, row_number() OVER (PARTITION BY source ORDER BY r, node) AS rk{guard} FROM (SELECT a.source, e.dst AS node, "
            f"sum(a.sigma) AS sigma, arg_min(a.node, a.rk) AS parent, min(a.rk) AS r FROM {name}{k - 1} a JOIN e ON e.src = a.node WHERE true{seen} GROUP BY 1, 2)",
        ))
    union = " UNION ALL ".join(f"SELECT source, node, {k}::BIGINT AS d, sigma, parent FROM {name}{k}" for k in range(LEVELS))
    # the guarded level is read, so that it cannot be dropped
    union += f" UNION ALL SELECT source, node, {LEVELS}, sigma, parent FROM {name}{LEVELS} WHERE stop IS NULL"
    return [*out, (name, union)]


def dependency(name: str, of: str) -> list[tuple[str, str]]:
    """CTE <name> (source, node, delta) over the levels of the search ``of``."""
    out = [(f"{name}{LEVELS - 1}", f"SELECT source, node, sigma, 0::DOUBLE AS delta FROM {of}{LEVELS - 1}")]
    for k in range(LEVELS - 2, 0, -1):
        out.append((
            f"{name}{k}",
            f"SELECT v.source, v.node, v.sigma, v.sigma * coalesce(x.share, 0) AS delta FROM {of}{k} v LEFT JOIN "
            f"(SELECT w.source, e.src AS node, sum((1 + w.delta) / w.sigma) AS share FROM {name}{k + 1} w JOIN e ON e.dst = w.node GROUP BY 1, 2) x "
            "ON x.source = v.source AND x.node = v.node",
        ))
    return [*out, (name, " UNION ALL ".join(f"SELECT source, node, delta FROM {name}{k}" for k in range(1, LEVELS)))]


def share(w: str, by: str) -> str:
    return f"{w} / sum({w}) OVER (PARTITION BY {by})"


CAND = "SELECT b.source AS target, b.node, b.d, b.sigma, b.parent, nd.deg, {lam} AS lam FROM bt b JOIN nd ON nd.node = b.node, sc WHERE b.d > 0"
JUMP = "CASE WHEN sc.avg_deg < 1 THEN 1.01 ELSE sc.avg_deg END"


def model(name: str) -> str:
    """(target, node, p) of a pivot model, over CTEs cj, cl, wd, chat."""

    def finish(rows: str, weight: str) -> str:
        return f"SELECT target, node, w / sum(w) OVER (PARTITION BY target) AS p FROM (SELECT target, node, {weight} AS w FROM {rows})"

    inv = "1 / deg::DOUBLE"
    level = f"(SELECT *, {share(inv, 'target, d')} AS q, count(*) OVER (PARTITION BY target, d) AS size FROM cj)"
    inv_sq = "1 / (deg + 1e-9::DOUBLE)"
    level_sq = f"(SELECT *, {share(inv_sq, 'target, d')} AS q, count(*) OVER (PARTITION BY target, d) AS size FROM cl)"
    return {
        "flat": finish("cj", "pow(lam, -d) / greatest(1, deg)"),
        "level": finish(level, "pow(lam, -d) * q"),
        "paper": finish(level, "pow(lam, -d) * q * size"),
        "level_sq": finish(level_sq, "pow(lam, -d) * q * size * size"),
        "weddbm": finish("(SELECT *, avg(deg) OVER (PARTITION BY target, d) AS a FROM cj JOIN wd USING (node))", "pow(CASE WHEN a < 1 THEN 1.01 ELSE a END, -d) / greatest(1, wdeg)"),
        "caeddbm": finish("chat", "pow(lam, -d) / (deg * (1 + chat))"),
        "pdeddbm": finish("cj", "sigma / (deg * pow(lam, d))"),
        "uniform": "SELECT target, node, 1 / (n - 1)::DOUBLE AS p FROM nd, tg, sc WHERE node <> target",
    }[name]


FUSION = "SELECT target, node, sum(p) / 3 AS p FROM (SELECT * FROM p_weddbm UNION ALL SELECT * FROM p_caeddbm UNION ALL SELECT * FROM p_pdeddbm) GROUP BY 1, 2"


def draws(name: str, probs: str, t_most: int, seed: int) -> list[tuple[str, str]]:
    """CTE <name> (target, t, node, p)."""
    u = uniform_sql(key_sql("target", "t", seed=seed))
    return [
        (f"{name}_cum", f"SELECT target, node, p, round(sum(p) OVER (PARTITION BY target ORDER BY node ROWS UNBOUNDED PRECEDING), 12) AS x FROM {probs}"),
        (f"{name}_u", f"SELECT target, t, {u} AS u FROM (SELECT DISTINCT target FROM {probs}), (SELECT unnest(range(1, {t_most + 1})) AS t)"),
        (
            name,
            f"SELECT k.target, k.t, k.node, c.p FROM (SELECT d.target, d.t, coalesce(min(c.node) FILTER (WHERE c.x >= d.u), max(c.node)) AS node "
            f"FROM {name}_u d JOIN {name}_cum c ON c.target = d.target GROUP BY 1, 2) k JOIN {name}_cum c ON c.target = k.target AND c.node = k.node",
        ),
    ]


def contributions(name: str, drawn: str) -> list[tuple[str, str]]:
    return [(name, f"SELECT r.target, r.t, r.node, r.p, coalesce(a.delta, 0) AS delta, coalesce(a.delta, 0) / greatest(r.p, 1e-12::DOUBLE) AS value FROM {drawn} r LEFT JOIN da a ON a.source = r.node AND a.node = r.target")]


def parts(graph: str) -> dict[str, list[tuple[str, str]]]:
    sets = {
        "e": [("pairs", PAIRS[graph]), ("e", "SELECT a AS src, b AS dst FROM pairs UNION ALL SELECT b, a FROM pairs")],
        "nd": [("nd", "SELECT src AS node, count(*) AS deg FROM e GROUP BY 1")],
        "sc": [("sc", "SELECT count(*) AS n, (sum(deg) // 2)::BIGINT AS m, avg(deg) AS avg_deg, max(deg) AS max_deg FROM nd")],
        "tg": [("tg", f"SELECT node AS target FROM nd ORDER BY deg DESC, node LIMIT {TARGETS}")],
        "bt": bfs("bt", "SELECT target AS s FROM tg"),
        "ba": bfs("ba", "SELECT node AS s FROM nd"),
        "da": dependency("da", "ba"),
        "bc": [("bc", "SELECT nd.node, coalesce(sum(delta), 0) / 2 AS bc FROM nd LEFT JOIN da ON da.node = nd.node GROUP BY 1")],
        "cj": [("cj", CAND.format(lam=JUMP))],
        "cl": [("cl", CAND.format(lam="greatest(sc.avg_deg, 1.001)"))],
        "wd": [("wd", "SELECT e.src AS node, sum(nd.deg)::BIGINT AS wdeg FROM e JOIN nd ON nd.node = e.dst GROUP BY 1")],
        "chat": [
            ("common", "SELECT x.src AS node, y.src AS parent, count(*) AS common FROM (SELECT DISTINCT node, parent FROM cj) q JOIN e x ON x.src = q.node JOIN e y ON y.src = q.parent AND y.dst = x.dst GROUP BY 1, 2"),
            ("chat", "SELECT cj.*, coalesce(common, 0) / greatest(1, deg) AS chat FROM cj LEFT JOIN common USING (node, parent)"),
        ],
        "tri": [
            ("tri3", "SELECT p.a AS x, p.b AS y, q.b AS z FROM pairs_c p JOIN pairs_c q ON q.a = p.b JOIN pairs_c r ON r.a = p.a AND r.b = q.b"),
            ("tri", "SELECT node, count(*) AS triangles FROM (SELECT x AS node FROM tri3 UNION ALL SELECT y FROM tri3 UNION ALL SELECT z FROM tri3) GROUP BY 1"),
            ("cc", "SELECT nd.node, nd.deg, coalesce(triangles, 0) AS triangles, CASE WHEN deg >= 2 THEN 2 * coalesce(triangles, 0) / (deg * (deg - 1))::DOUBLE ELSE 0 END AS clustering FROM nd LEFT JOIN tri ON tri.node = nd.node"),
        ],
        "pairs_c": [("pairs_c", "SELECT src AS a, dst AS b FROM e WHERE src < dst")],
        "nb": [("nb", "SELECT e.src AS node, count(*) AS deg, avg(nd.deg) AS nb_avg, min(nd.deg) AS nb_min, max(nd.deg) AS nb_max, stddev_pop(nd.deg) AS nb_std, sum(nd.deg)::BIGINT AS nb_sum, sum(1 / nd.deg::DOUBLE) AS inv_sum, count(*) FILTER (WHERE nd.deg > sc.avg_deg) AS nb_high FROM e JOIN nd ON nd.node = e.dst, sc GROUP BY 1")],
        "two": [
            ("paths", "SELECT a.src AS node, b.dst AS far, count(*) AS n FROM e a JOIN e b ON b.src = a.dst WHERE b.dst <> a.src AND NOT EXISTS (SELECT 1 FROM e c WHERE c.src = a.src AND c.dst = b.dst) GROUP BY 1, 2"),
            ("two", "SELECT nd.node, (nd.deg + coalesce(p, 0))::BIGINT AS reach2_paths, (nd.deg + coalesce(k, 0))::BIGINT AS reach2_nodes FROM nd LEFT JOIN (SELECT node, sum(n) AS p, count(*) AS k FROM paths GROUP BY 1) q ON q.node = nd.node"),
        ],
    }
    for m in ("flat", "level", "paper", "level_sq", "weddbm", "caeddbm", "pdeddbm", "uniform"):
        sets[f"p_{m}"] = [(f"p_{m}", model(m))]
    sets["p_fusion"] = [("p_fusion0", FUSION), ("p_fusion", "SELECT target, node, p / sum(p) OVER (PARTITION BY target) AS p FROM p_fusion0")]
    sets["opt"] = [("opt", "SELECT da.node AS target, source AS node, delta / sum(delta) OVER (PARTITION BY da.node) AS p FROM da JOIN tg ON tg.target = da.node WHERE delta > 0")]
    sets["draws"] = draws("dr", "p_level", 50, 7)
    sets["values"] = contributions("va", "dr")
    sets["est"] = [("est", "SELECT target, tt AS T, sum(value) / tt * 0.5::DOUBLE AS est FROM va, (SELECT unnest([1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50]) AS tt) WHERE t <= tt GROUP BY 1, 2")]
    # eccentricity and cores
    sets["be"] = bfs("be", "SELECT node AS s FROM nd ORDER BY node LIMIT 5")
    sets["ecc"] = [("ecc", "SELECT nd.node, CASE WHEN met = k THEN far ELSE n END AS ecc FROM nd LEFT JOIN (SELECT node, max(d) AS far, count(*) AS met FROM be GROUP BY 1) q ON q.node = nd.node, (SELECT count(DISTINCT source) AS k FROM be), sc")]
    u = uniform_sql(key_sql("node", seed=0))
    sets["bd"] = bfs("bd", f"SELECT node AS s FROM nd ORDER BY {u}, node LIMIT 5")
    sets["diam"] = [("diam", "SELECT greatest(coalesce(max(d), 1), 1)::BIGINT AS diameter FROM bd")]
    cores, rounds = [("k0", "SELECT node, deg AS core FROM nd")], CORE_ROUNDS.get(graph, 24)
    for i in range(1, rounds + 1):
        cores.append((
            f"k{i}",
            f"SELECT node, max(least(core, r)) AS core FROM (SELECT e.src AS node, k.core, row_number() OVER (PARTITION BY e.src ORDER BY k.core DESC) AS r FROM e JOIN k{i - 1} k ON k.node = e.dst) GROUP BY 1",
        ))
    sets["core"] = [*cores, ("core", f"SELECT a.node, CASE WHEN a.core <> b.core THEN error('more rounds') ELSE a.core END AS core FROM k{rounds} a JOIN k{rounds - 1} b USING (node)")]
    return sets


#: Of the fixpoint of h-indices; graphs with long chains need more.
CORE_ROUNDS = {"months": 60}

NEEDS = {
    "e": [], "nd": ["e"], "sc": ["nd"], "tg": ["nd"], "bt": ["tg"], "ba": ["nd"], "da": ["ba"], "bc": ["da", "nd"], "cj": ["bt", "sc"], "cl": ["bt", "sc"],
    "wd": ["nd"], "chat": ["cj"], "pairs_c": ["e"], "tri": ["pairs_c", "nd"], "nb": ["sc"], "two": ["nd"], "p_flat": ["cj"], "p_level": ["cj"], "p_paper": ["cj"],
    "p_level_sq": ["cl"], "p_weddbm": ["cj", "wd"], "p_caeddbm": ["chat"], "p_pdeddbm": ["cj"], "p_uniform": ["tg", "sc"],
    "p_fusion": ["p_weddbm", "p_caeddbm", "p_pdeddbm"], "opt": ["da", "tg"], "draws": ["p_level"], "values": ["draws", "da"], "est": ["values"],
    "be": ["nd"], "ecc": ["be", "sc"], "bd": ["nd"], "diam": ["bd"], "core": ["nd"],
}


def query(graph: str, needs: list[str], final: str, more: list[tuple[str, str]] | None = None, targets: list[tuple[str, str]] | None = None) -> str:
    """``final`` over the named sets of CTEs of a graph and all that these need, then ``more``; ``targets``, made from bc, in place of the top nodes."""
    sets, done, ctes = parts(graph), set(), []
    wanted = NEEDS
    if targets is not None:
        sets["tg"], wanted = targets, NEEDS | {"tg": ["bc"]}

    def add(name: str) -> None:
        if name not in done:
            done.add(name)
            for n in wanted[name]:
                add(n)
            ctes.extend(sets[name])

    for n in needs:
        add(n)
    ctes += more or []
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in ctes) + f"\n{final}"
