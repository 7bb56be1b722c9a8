"""Structural features of nodes and pairs. Each piece is one join and aggregate; sets are one wide join of pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written
from . import pivots, traverse
from .ranks import with_rank
from .scalars import GraphOf, beside, common_neighbours, connected_components, degrees, summary

MOST_GRAPH_EDGES = 8_000_000  # of a graph whose arrays are one task's; what ``pieces`` tells of larger ones is found by joins
MOST_WEDGES = 1 << 22  # that are looked up at once


def neighbour_statistics(edges: DataFrame) -> DataFrame:
    """(node, deg, nb_avg, nb_min, nb_max, nb_std, nb_sum, inv_sum, nb_high): of the neighbours' degrees.

    nb_std is the population deviation; nb_high counts neighbours above the average degree.
    """
    deg = degrees(edges)
    avg = deg.agg(F.avg("deg").alias("__avg"))
    near = edges.join(deg.withColumnRenamed("node", "dst"), "dst").join(F.broadcast(avg))  # one row
    return near.groupBy(F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("deg"),
        F.avg("deg").alias("nb_avg"),
        F.min("deg").alias("nb_min"),
        F.max("deg").alias("nb_max"),
        F.stddev_pop("deg").alias("nb_std"),
        F.sum("deg").alias("nb_sum"),
        F.sum(1 / F.col("deg")).alias("inv_sum"),
        F.count_if(F.col("deg") > F.col("__avg")).alias("nb_high"),
    )


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles): edges point from lower to higher (degree, id), which bounds the wedges of hubs."""
    deg = degrees(edges)
    e = edges.join(deg.select(F.col("node").alias("src"), F.col("deg").alias("ds")), "src").join(deg.select(F.col("node").alias("dst"), F.col("deg").alias("dd")), "dst")
    up = e.filter(F.struct("ds", "src") < F.struct("dd", "dst")).select("src", "dst")
    a = up.select(F.col("src").alias("x"), F.col("dst").alias("y"))
    b = up.select(F.col("src").alias("x"), F.col("dst").alias("z"))
    c = up.select(F.col("src").alias("y"), F.col("dst").alias("z"))
    closed = a.join(b, "x").join(c, ["y", "z"])
    return closed.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, deg, triangles, clustering); 0 below two neighbours."""
    t = degrees(edges).join(triangles(edges), "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    d = F.col("deg")
    return t.withColumn("clustering", F.when(d >= 2, 2 * F.col("triangles") / (d * (d - 1))).otherwise(F.lit(0.0)))


def without_trees(edges: DataFrame) -> DataFrame:
    """The edges between nodes of core 2 and more: hanging trees are taken off.

    A round takes off whole chains: nodes of degree 2 and less form paths and rings, and a path with an end of degree 1
    goes at once, however long it is. Each round at least halves the ends, so rounds grow with the logarithm of the nodes.
    """
    while True:
        deg = written(degrees(edges), "degrees")
        if deg.filter("deg = 1").isEmpty():
            return edges
        low = deg.filter("deg <= 2")
        ends = low.select(F.col("node").alias("src"), F.col("deg").alias("ds"))
        between = edges.join(ends, "src").join(low.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
        labels = connected_components(written(between, "chains")).withColumnRenamed("component", "chain")
        chains = low.join(labels, "node", "left").withColumn("chain", F.coalesce("chain", "node"))
        gone = chains.filter("deg = 1").select("chain").distinct()
        gone = written(chains.join(gone, "chain", "left_semi").select("node"), "hanging")
        for end in ("src", "dst"):
            edges = edges.join(gone.withColumnRenamed("node", end), end, "left_anti")
        edges = written(edges.select("src", "dst"), "edges")


def core_numbers(edges: DataFrame) -> DataFrame:
    """(node, core): exact. Hanging trees have 1; of the rest, the fixpoint of each node's h-index of its neighbours' values, from the degrees down."""
    nodes = degrees(edges).select("node")
    edges = without_trees(edges)
    core = written(degrees(edges).select("node", F.col("deg").alias("core")), "core")
    while True:
        near = edges.join(core.select(F.col("node").alias("dst"), F.col("core").alias("c")), "dst")
        # counts of equal values first: a hub's neighbours have few distinct ones
        n = near.groupBy("src", "c").agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("c")))
        h = n.select("src", F.least("c", above).alias("h")).groupBy(F.col("src").alias("node")).agg(F.max("h").alias("h"))
        step = written(core.join(h, "node").select("node", F.col("core").alias("old"), F.least("core", "h").alias("core")), "core")
        if step.filter(F.col("old") != F.col("core")).isEmpty():
            return nodes.join(step.select("node", "core"), "node", "left").select("node", F.coalesce("core", F.lit(1).cast("long")).alias("core"))
        core = step.select("node", "core")


def least_of_parts(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Of each place below ``n``, the least place of its connected part; rounds are those of ``connected_components``."""
    least = np.arange(n)
    while len(src):
        to = np.arange(n)
        np.minimum.at(to, src, dst)
        while not np.array_equal(far := to[to], to):
            to = far
        least, src, dst = to[least], to[src], to[dst]
        across = src != dst
        src, dst = src[across], dst[across]
    return least


def peeled(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Core numbers of compressed rows: nodes of the least degree that is left are taken off, again and again."""
    left = np.diff(at)
    core, there, rest, k = np.zeros(len(left), np.int64), np.ones(len(left), bool), np.arange(len(left)), 0
    while len(rest):
        k = max(k, int(left[rest].min()))
        off = rest[left[rest] <= k]
        while len(off):
            core[off], there[off] = k, False
            n = at[off + 1] - at[off]
            near = to[np.arange(n.sum()) + np.repeat(at[off] - np.cumsum(n) + n, n)]
            near = near[there[near]]
            np.subtract.at(left, near, 1)
            off = np.unique(near[left[near] <= k])
        rest = rest[there[rest]]
    return core


def corners(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Of each node of compressed rows, the triangles that it is in; edges point from lower to higher (degree, place), as in ``triangles``."""
    n = len(at) - 1
    by = np.argsort(np.diff(at), kind="stable")
    rank = np.argsort(by)
    src, dst = rank[np.repeat(np.arange(n), np.diff(at))], rank[to]
    up = np.sort((src * n + dst)[src < dst])
    src, dst = up // n, up % n
    at = np.searchsorted(src, np.arange(n + 1))
    many = np.diff(at)[dst]
    ends, found, lo = np.cumsum(many), np.zeros(n, np.int64), 0
    while lo < len(up):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MOST_WEDGES, "right")))
        e, k = np.repeat(np.arange(lo, hi), many[lo:hi]), many[lo:hi]
        z = dst[np.arange(len(e)) + np.repeat(at[dst[lo:hi]] - np.cumsum(k) + k, k)]
        want = src[e] * n + z
        closed = up[np.minimum(np.searchsorted(up, want), len(up) - 1)] == want
        for x in (src[e[closed]], dst[e[closed]], z[closed]):
            found += np.bincount(x, minlength=n)
        lo = hi
    return found[rank]


def farthest(at: np.ndarray, to: np.ndarray, anchors: int) -> np.ndarray:
    """Of each node of compressed rows, the greatest distance to the first ``anchors`` nodes; the number of nodes if one is out of reach."""
    n = len(at) - 1
    far = np.zeros(n, np.int64)
    for a in range(min(anchors, n)):
        dist, front, d = np.full(n, n), np.array([a]), 0
        dist[a] = 0
        while len(front):
            d += 1
            k = at[front + 1] - at[front]
            near = to[np.arange(k.sum()) + np.repeat(at[front] - np.cumsum(k) + k, k)]
            front = np.unique(near[dist[near] > d])
            dist[front] = d
        far = np.maximum(far, dist)
    return far


def pieces(edges: DataFrame, graph: GraphOf, anchors: int = 5) -> DataFrame:
    """(node, component, core, deg, nb_avg, clustering, ecc) of a forest's nodes, as the functions of these names give them.

    Edges are shuffled once, one way of each, by graph, and a task takes its graphs one after the other; no rounds of jobs. Graphs of more than
    ``MOST_GRAPH_EDGES`` edges go by joins. Edges are evaluated more than once: write costly ones first.
    """
    of = edges.select(graph(F.col("src")).alias("graph"), F.col("src").cast("long"), F.col("dst").cast("long"))
    half = of.filter("src <= dst")
    large = written(of.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_GRAPH_EDGES).select("graph"), "large-graphs")
    some_large = not large.isEmpty()
    tasks = 4 * max(edges.sparkSession.sparkContext.defaultParallelism, 1)
    dealt = (half.join(large.hint("merge"), "graph", "left_anti") if some_large else half).repartition(tasks, "graph").sortWithinPartitions("graph")
    names = ["node", "component", "core", "deg", "nb_avg", "clustering", "ecc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, src, dst in whole_graphs(batches):
            ids, at, d = rows_of(src, dst)
            deg = np.diff(at)
            s = np.repeat(np.arange(len(ids)), deg)
            sums = np.bincount(s, deg[d], len(ids))  # whole numbers
            closed = np.where(deg > 1, 2 * corners(at, d) / np.maximum(deg * (deg - 1), 1), 0.0)
            columns = (ids, ids[least_of_parts(len(ids), s, d)], peeled(at, d), deg, sums / deg, closed, farthest(at, d, anchors).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    found = dealt.mapInArrow(run, "node long, component long, core long, deg long, nb_avg double, clustering double, ecc int")
    if some_large:
        rest = written(of.join(large.hint("merge"), "graph", "left_semi").select("src", "dst"), "edges")
        labels = written(connected_components(rest), "labels")
        more = (
            neighbour_statistics(rest)
            .select("node", "deg", "nb_avg")
            .join(clustering(rest).select("node", "clustering"), "node")
            .join(traverse.eccentricity_estimate(rest, anchors, graph, labels), "node")
        )
        found = found.unionByName(labels.join(core_numbers(rest).hint("merge"), "node").join(more, "node").select(*names))
    return written(found, "structure")


def structure(edges: DataFrame, graph: GraphOf) -> DataFrame:
    """(node, component, core) of a forest's nodes, as ``connected_components`` and ``core_numbers`` give them."""
    return pieces(edges, graph).select("node", "component", "core")


def rows_of(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, at, to): compressed rows of edges of which one way is given; neighbours ascend."""
    across = src != dst
    src, dst = np.concatenate([src, dst[across]]), np.concatenate([dst, src[across]])
    ids, s = np.unique(src, return_inverse=True)
    d = np.searchsorted(ids, dst)
    order = np.lexsort((d, s))
    return ids, np.searchsorted(s[order], np.arange(len(ids) + 1)), d[order]


def whole_graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(graph, src, dst) of rows that are sorted by graph."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    for b in batches:
        g, src, dst = (c.to_numpy() for c in b.columns)
        begins = np.flatnonzero(np.diff(g)) + 1
        for lo, hi in zip([0, *begins.tolist()], [*begins.tolist(), len(g)], strict=True):
            if lo == hi:
                continue
            if held and held[0][0] != g[lo]:
                yield held[0][0], *(np.concatenate([x[i] for x in held]) for i in (1, 2))
                held = []
            held.append((int(g[lo]), src[lo:hi], dst[lo:hi]))
    if held:
        yield held[0][0], *(np.concatenate([x[i] for x in held]) for i in (1, 2))


def two_hops(edges: DataFrame) -> DataFrame:
    """(node, reach2_paths, reach2_nodes): neighbours plus two-paths out of the neighbourhood, or their distinct ends.

    Paths are not listed: a node has as many as its neighbours' other edges, less two for each of its triangles. Distinct
    ends are sets of bits: nodes are numbered by falling degree, a neighbourhood is its words of 64 numbers, and a node's
    ends are the union of its neighbours' words, so hubs, which share words, cost little.
    """
    deg = written(degrees(edges), "degrees")
    near = edges.join(deg.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("deg").alias("steps"))
    number = written(with_rank(deg, "number", [F.desc("deg"), F.col("node")]).select("node", "number"), "numbers")
    bit = F.expr("shiftleft(1L, CAST(number & 63 AS INT))")
    words = edges.join(number.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), F.shiftright("number", 6).alias("word"), bit.alias("bit"))
    words = written(words.groupBy("node", "word").agg(F.bit_or("bit").alias("bits")), "words")
    ends = edges.join(words.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
    own = words.withColumnRenamed("bits", "own").unionByName(number.select("node", F.shiftright("number", 6).alias("word"), bit.alias("own"))).groupBy("node", "word").agg(F.bit_or("own").alias("own"))
    far = ends.join(own, ["node", "word"], "left").groupBy("node").agg(F.sum(F.bit_count(F.expr("bits & ~coalesce(own, 0L)"))).alias("ends"))
    return deg.join(near, "node").join(triangles(edges), "node", "left").join(far, "node").select(
        "node", (F.col("steps") - 2 * F.coalesce("triangles", F.lit(0))).alias("reach2_paths"), (F.col("deg") + F.col("ends")).alias("reach2_nodes")
    )


def graph_record(edges: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """One row: n, m, avg_deg, max_deg, diameter (estimated), max_core, triangles."""
    return (
        summary(edges)
        .join(F.broadcast(traverse.diameter_estimate(edges, k, seed)))
        .join(F.broadcast(core_numbers(edges).agg(F.max("core").alias("max_core"))))
        .join(F.broadcast(triangles(edges).agg(F.coalesce((F.sum("triangles") / 3).cast("long"), F.lit(0)).alias("triangles"))))
    )


def node8a(edges: DataFrame, anchors: int = 5, graph: GraphOf = None, known: DataFrame | None = None) -> DataFrame:
    """Eight features: degree, clustering, core, neighbour degree, log degree, leaf, degree ratio, eccentricity; relative to the node's graph.

    ``known``: ``pieces`` of a forest, if they are there already.
    """
    if graph is not None:
        rows = pieces(edges, graph, anchors) if known is None else known
    else:
        rows = (
            neighbour_statistics(edges)
            .join(clustering(edges).select("node", "clustering"), "node")
            .join(core_numbers(edges), "node")
            .join(traverse.eccentricity_estimate(edges, anchors), "node")
        )
        rows = written(rows, "node8-parts")  # read twice
    top = (F.max("deg").alias("max_deg"), F.avg("deg").alias("avg_deg"), F.max("core").alias("max_core"), F.max("nb_avg").alias("max_nb"), F.count(F.lit(1)).alias("n"))
    d = F.col("deg")
    return beside(rows, rows, *top, graph=graph).select(
        "node",
        (d / F.col("max_deg")).alias("f0"),
        F.col("clustering").alias("f1"),
        (F.col("core") / F.col("max_core")).alias("f2"),
        (F.col("nb_avg") / (F.col("max_nb") + 1e-9)).alias("f3"),
        (F.log1p(d) / F.log1p(F.col("max_deg") + 1)).alias("f4"),
        (d == 1).cast("double").alias("f5"),
        (d / (F.col("avg_deg") + 1e-9)).alias("f6"),
        (F.col("ecc") / (F.col("n") + 1)).alias("f7"),
    )


def node8b(edges: DataFrame, reach: str = "reach2_paths") -> DataFrame:
    """The eight columns of the training files."""
    rows = neighbour_statistics(edges).join(clustering(edges).select("node", "clustering"), "node").join(two_hops(edges), "node").join(F.broadcast(summary(edges).drop("m")))
    d, n = F.col("deg"), F.col("n")
    return rows.select(
        "node",
        F.log1p(d).alias("log_degree"),
        (d / F.greatest(F.lit(1), n - 1)).alias("degree_centrality"),
        F.log1p("nb_avg").alias("log_nb_avg_deg"),
        (F.col("nb_max") / F.col("max_deg")).alias("nb_max_deg_norm"),
        "clustering",
        F.log1p(reach).alias("log_reach2"),
        (F.col(reach) / F.greatest(F.lit(1), n)).alias("reach2_norm"),
        (d / F.col("avg_deg")).alias("deg_over_avg"),
    )


def node12(edges: DataFrame) -> DataFrame:
    """node8b over distinct ends, and the neighbour degrees' variation, PageRank and eigenvector proxies, graph size."""
    extra = neighbour_statistics(edges).join(F.broadcast(summary(edges).select("n"))).select(
        "node",
        (F.col("nb_std") / F.greatest(F.lit(1.0), F.col("nb_avg"))).alias("nb_cv"),
        F.log1p("inv_sum").alias("log_inv_sum"),
        F.log1p("nb_sum").alias("log_nb_sum"),
        F.log1p("n").alias("log_n"),
    )
    return node8b(edges, "reach2_nodes").join(extra, "node")


def node20(edges: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """Twenty features f1 .. f20."""
    g = graph_record(edges, k, seed).drop("triangles", "m")
    rows = (
        neighbour_statistics(edges)
        .join(clustering(edges).select("node", "clustering", "triangles"), "node")
        .join(core_numbers(edges), "node")
        .join(two_hops(edges), "node")
        .join(F.broadcast(g))
    )
    d, n, avg, reach = F.col("deg"), F.col("n"), F.col("avg_deg"), F.col("reach2_nodes")
    one = F.lit(1)
    f = [
        F.log1p(d), d / F.greatest(one, n - 1), F.log1p("nb_avg"), F.col("nb_std") / F.greatest(F.lit(1.0), F.col("nb_avg")), F.log1p("nb_max"),
        F.log1p(reach), reach / F.greatest(one, n), F.col("clustering"), F.log1p("core"), F.col("core") / F.greatest(one, F.col("max_core")),
        F.log1p("triangles"), F.log1p(avg), F.log1p(n), F.log1p("diameter"), d / F.greatest(F.lit(1.0), avg), F.log1p(d * F.col("nb_avg")),
        F.col("nb_min") / F.greatest(F.lit(1.0), F.col("nb_max").cast("double")), F.log1p("nb_high"), d / F.greatest(one, F.col("max_deg")), F.log1p("nb_sum"),
    ]
    return rows.select("node", *[x.alias(f"f{i}") for i, x in enumerate(f, 1)])


def pivot6(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, node, d, log_deg, log_sigma, chat, log_level, log_parent_deg) of reached nodes."""
    mean = F.avg("deg").over(Window.partitionBy("target", "d"))
    rows = pivots.candidates(edges, targets).withColumn("lev", F.greatest(F.lit(1.01), mean))
    rows = pivots.parent_overlap(edges, rows).join(degrees(edges).select(F.col("node").alias("parent"), F.col("deg").alias("dp")), "parent", "left")
    return rows.select(
        "target", "node", F.col("d").cast("double").alias("d"), F.log1p("deg").alias("log_deg"), F.log1p("sigma").alias("log_sigma"), "chat",
        F.log1p("lev").alias("log_level"), F.log1p(F.coalesce("dp", F.lit(0))).alias("log_parent_deg"),
    )


def pivot13(edges: DataFrame, targets: DataFrame, anchors: int = 5, graph: GraphOf = None, feats: DataFrame | None = None) -> DataFrame:
    """(target, node, g0 .. g12) for every node (of the target's graph) but the target; an unreached node has distance 999.

    ``feats``: columns f1 and f2 of ``node8a``, if they are there already.
    """
    feats = feats if feats is not None else written(node8a(edges, anchors, graph).select("node", "f1", "f2"), "node8")
    reached = traverse.bfs(edges, targets).select(F.col("source").alias("target"), "node", "d")
    counts = reached.groupBy("target", "d").agg(F.count(F.lit(1)).alias("sibs"))
    deg = degrees(edges)
    wanted = targets.select(F.col(targets.columns[0]).alias("target")).distinct()
    # every node of its graph for every target is the result itself
    inside = F.lit(True) if graph is None else graph(F.col("node")) == graph(F.col("target"))
    rows = (
        deg.join(wanted, inside & (F.col("node") != F.col("target")))
        .join(reached, ["target", "node"], "left")
        .withColumn("d", F.coalesce("d", F.lit(999)))
        .join(counts, ["target", "d"], "left")
        .join(deg.select(F.col("node").alias("target"), F.col("deg").alias("dv")), "target")
        .join(feats, "node")
        .join(feats.select(F.col("node").alias("target"), F.col("f1").alias("t1"), F.col("f2").alias("t2")), "target")
    )
    rows = beside(rows, deg, F.count(F.lit(1)).alias("n"), F.avg("deg").alias("avg_deg"), graph=graph)
    d = F.col("d")
    g = [
        d / (F.col("n") + 1), F.pow(F.greatest("avg_deg", F.lit(1.001)), -F.least(d, F.lit(20))), 1 / (F.col("deg") + 1e-9), 1 / (F.col("dv") + 1e-9),
        F.col("deg") / (F.col("avg_deg") + 1e-9), F.col("f1"), F.col("f2"), 1 / (F.coalesce("sibs", F.lit(1)) + 1), F.col("t1"), F.col("t2"),
        (d == 1).cast("double"), (d == 2).cast("double"), F.log1p(d),
    ]
    return rows.select("target", "node", *[x.cast("double").alias(f"g{i}") for i, x in enumerate(g)])


def pair16(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, diff_*, abs_*): differences of node features and their absolute values."""
    names = [c for c in features.columns if c != "node"]
    u = features.select(F.col("node").alias("u"), *[F.col(c).alias(f"u_{c}") for c in names])
    v = features.select(F.col("node").alias("v"), *[F.col(c).alias(f"v_{c}") for c in names])
    j = pairs.join(u, "u").join(v, "v")
    diff = [(F.col(f"u_{c}") - F.col(f"v_{c}")) for c in names]
    return j.select("u", "v", *[x.alias(f"diff_{c}") for c, x in zip(names, diff, strict=True)], *[F.abs(x).alias(f"abs_{c}") for c, x in zip(names, diff, strict=True)])


def pair45(edges: DataFrame, pairs: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """(u, v, u_f1 .., v_f1 .., dist, log_common, jaccard, deg_diff, deg_greater)."""
    feats = written(node20(edges, k, seed), "node20")
    deg = degrees(edges)
    rows = common_neighbours(edges, traverse.pair_distances(edges, pairs)).join(F.broadcast(traverse.diameter_estimate(edges, k, seed)))
    rows = rows.join(deg.select(F.col("node").alias("u"), F.col("deg").alias("du")), "u").join(deg.select(F.col("node").alias("v"), F.col("deg").alias("dv")), "v")
    for end in ("u", "v"):
        rows = rows.join(feats.select(F.col("node").alias(end), *[F.col(f"f{i}").alias(f"{end}_f{i}") for i in range(1, 21)]), end)
    return rows.select(
        "u", "v", *[f"u_f{i}" for i in range(1, 21)], *[f"v_f{i}" for i in range(1, 21)],
        (F.col("d") / F.greatest(F.lit(1), F.col("diameter"))).alias("dist"), F.log1p("common").alias("log_common"), "jaccard",
        (F.abs(F.col("du") - F.col("dv")) / F.greatest(F.lit(1), F.greatest("du", "dv"))).alias("deg_diff"), (F.col("du") > F.col("dv")).cast("double").alias("deg_greater"),
    )


def normalised_adjacency(edges: DataFrame, how: str = "symmetric") -> DataFrame:
    """(src, dst, weight): 1 / sqrt(d_src d_dst), or 1 / d_src with ``how='row'``."""
    deg = degrees(edges)
    e = edges.join(deg.select(F.col("node").alias("src"), F.col("deg").alias("ds")), "src")
    if how == "row":
        return e.select("src", "dst", (1 / F.col("ds")).alias("weight"))
    e = e.join(deg.select(F.col("node").alias("dst"), F.col("deg").alias("dd")), "dst")
    return e.select("src", "dst", (1 / F.sqrt(F.col("ds").cast("double") * F.col("dd"))).alias("weight"))
