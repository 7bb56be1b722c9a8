"""Hand-checked graphs, both traversal plans, and invariants."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from betwixt.operators import concordance, datasets, estimate, features, generators, metrics, models, pivots, scalars, traverse
from betwixt.sources import edges as io

HAND = {
    "path": ([(0, 1), (1, 2), (2, 3), (3, 4)], [0, 3, 4, 3, 0]),
    "star": ([(0, 1), (0, 2), (0, 3), (0, 4)], [6, 0, 0, 0, 0]),
    "five-ring": ([(0, 1), (1, 2), (2, 3), (3, 4), (4, 0)], [1] * 5),
    "four-ring": ([(0, 1), (1, 2), (2, 3), (3, 0)], [0.5] * 4),
    "complete": (list(itertools.combinations(range(4), 2)), [0] * 4),
    "triangles": ([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)], [0, 0, 6, 6, 0, 0]),
    "apart": ([(0, 1), (1, 2), (3, 4)], [0, 1, 0, 0, 0]),
}


def graph(spark, pairs):
    return io.symmetric(io.canonical(spark.createDataFrame(pairs, "a long, b long"))).cache()


@pytest.mark.parametrize("name", HAND)
def test_exact_betweenness(spark, name):
    pairs, want = HAND[name]
    got = [r.bc for r in traverse.betweenness(graph(spark, pairs)).orderBy("node").collect()]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("name", ["triangles", "apart"])
def test_plans_agree(spark, name):
    e = graph(spark, HAND[name][0])
    sources = e.select("src").distinct()
    for f in (traverse.bfs, traverse.dependencies):
        assert sorted(map(tuple, f(e, sources, "broadcast").collect()), key=str) == sorted(map(tuple, f(e, sources, "joins").collect()), key=str)
    a, b = (sorted(map(tuple, traverse.betweenness(e, p).collect())) for p in ("broadcast", "joins"))
    assert a == b


def test_multigraph_counts_parallel_edges(spark):
    e = io.symmetric(spark.createDataFrame([(0, 1), (0, 1), (1, 2), (2, 3), (3, 0)], "a long, b long"))
    got = [r.bc for r in traverse.betweenness(e).orderBy("node").collect()]
    assert got == pytest.approx([2 / 3, 2 / 3, 1 / 3, 1 / 3])


def test_sum_of_betweenness_is_sum_of_inner_path_lengths(spark):
    rng = random.Random(1)
    pairs = [(i, rng.randrange(i)) for i in range(1, 30)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(20)]
    e = graph(spark, pairs)
    total = sum(r.bc for r in traverse.betweenness(e).collect())
    reached = traverse.bfs(e, e.select("src").distinct()).filter("source < node").collect()
    assert total == pytest.approx(sum(r.d - 1 for r in reached))


def test_distributions_sum_to_one_and_expectation_is_exact(spark):
    e = graph(spark, HAND["triangles"][0])
    t = spark.createDataFrame([(2,)], "target long")
    dep = {r.source: r.delta for r in traverse.dependencies(e, e.select("src").distinct()).filter("node = 2").collect()}
    for name, f in pivots.MODELS.items():
        p = {r.node: r.p for r in f(e, t).collect()}
        assert sum(p.values()) == pytest.approx(1), name
        assert sum(p[s] * dep.get(s, 0) / p[s] for s in p) == pytest.approx(2 * 6), name


def test_guard(spark):
    with pytest.raises(ValueError):
        traverse.betweenness(graph(spark, HAND["path"][0]), most_nodes=3)


def test_reader_skips_what_is_no_edge(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# comment\n\n0 1\n1\t2 9\nx y\n3\n2 2\n1 0\n")
    assert sorted(map(tuple, io.read_graph(spark, str(tmp_path / "g.txt")).collect())) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert sorted(r.a for r in io.read_pairs(spark, str(tmp_path / "g.txt")).collect()) == [0, 1, 1, 2]
    shifted = io.read_graph(spark, str(tmp_path / "g.txt"), one_indexed=True)
    assert (0, -1) in set(map(tuple, shifted.collect()))
    assert io.raw_nodes(io.read_graph(spark, str(tmp_path / "g.txt"))).count() == 3


def test_round_trips(spark, tmp_path):
    e = graph(spark, HAND["triangles"][0])
    io.write_edges(e, str(tmp_path / "e"))
    assert sorted(map(tuple, io.read_graph(spark, str(tmp_path / "e")).collect())) == sorted(map(tuple, e.collect()))
    io.write_edges(e, str(tmp_path / "h"), header=["nodes 6", "edges 7"], sep="\t")
    assert sorted(map(tuple, io.read_graph(spark, str(tmp_path / "h")).collect())) == sorted(map(tuple, e.collect()))
    bc = traverse.betweenness(e)
    io.write_bc(bc, str(tmp_path / "bc"))
    assert sorted(map(tuple, io.read_bc(spark, str(tmp_path / "bc")).collect())) == sorted(map(tuple, bc.collect()))
    once = io.cached_bc(e, str(tmp_path / "cache"), traverse.betweenness).collect()
    assert sorted(once) == sorted(io.cached_bc(e, str(tmp_path / "cache"), lambda _: 1 / 0).collect())
    p = pivots.eddbm(e, spark.createDataFrame([(2,)], "target long"))
    io.write_probabilities(p, str(tmp_path / "p"), "p")
    back = io.read_probabilities(spark, str(tmp_path / "p"), 5)
    assert sum(r.prob for r in back.collect()) == pytest.approx(1)


def test_node_tables(spark, tmp_path):
    head = "node,bc," + ",".join(io.FEATURES)
    for k, n in (("graph_1", 25), ("graph_2", 3), ("real_x", 21)):
        (tmp_path / f"{k}.csv").write_text("\n".join([head, *[f"{i},0.5" + ",0.1" * 8 for i in range(n)]]))
    got = {r.graph_id: r["count"] for r in io.read_node_tables(spark, str(tmp_path)).groupBy("graph_id").count().collect()}
    assert got == {"graph_1": 25, "real_x": 21}
    (tmp_path / "e.txt").write_text("0 1\n1 99\n")
    nodes, edges = io.read_node_table(spark, str(tmp_path / "graph_1.csv"), str(tmp_path / "e.txt"))
    assert nodes.count() == 25 and edges.count() == 2
    assert io.read_node_table(spark, str(tmp_path / "graph_2.csv"), str(tmp_path / "e.txt"), 20) is None


def test_components_and_sampling(spark):
    e = graph(spark, HAND["apart"][0])
    assert {r.node: r.component for r in scalars.connected_components(e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert scalars.largest_component(e).count() == 4


@pytest.mark.parametrize("work, held", [(60, 10), (10**9, 10**6)])
def test_parts_plan(spark, monkeypatch, work, held):
    """Parts whose ids interleave, dealt in blocks of sources, or held together."""
    monkeypatch.setattr(traverse, "WORK", work)
    monkeypatch.setattr(traverse, "HELD", held)
    rng = random.Random(4)
    pairs = [(5 * rng.randrange(n) + c, 5 * rng.randrange(n) + c) for c, n, m in ((0, 4, 5), (1, 12, 25), (2, 9, 9), (3, 3, 2), (4, 20, 18)) for _ in range(m)]
    e = graph(spark, [p for p in pairs if p[0] != p[1]])
    nodes = e.select("src").distinct()
    some, wanted = nodes.filter("src % 3 = 0").unionByName(spark.createDataFrame([(9999,)], "src long")), nodes.filter("src % 2 = 1")

    def rows(df):
        return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)

    for f in (lambda p: traverse.betweenness(e, p), lambda p: traverse.dependencies(e, some, p, wanted), lambda p: traverse.bfs(e, some, p)):
        assert rows(f("parts")) == rows(f("broadcast")) != []


def test_components_evaluate_the_edges_twice(spark):
    """However many rounds a graph takes: rounds after the first see what is left of them only."""
    pairs = [(i, i + 1) for i in range(40)] + [(100 + i, 139 - i) for i in range(20)] + [(100 + i, 140 + (i * 7) % 20) for i in range(40)] + [(300 + i % 9, 200 + i) for i in range(30)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    e = graph(spark, pairs)
    n = e.count()
    got = {r.node: r.component for r in scalars.connected_components(e.mapInArrow(counted, e.schema)).collect()}
    assert seen.value <= 2 * n
    left = {x: x for p in pairs for x in p}
    for _ in range(len(left)):
        for u, v in pairs:
            left[u] = left[v] = min(left[u], left[v])
    assert got == left
    assert scalars.downsampled(e, 2).select("src").distinct().count() <= 2


def test_core_numbers_of_a_clique_with_a_tail(spark):
    pairs = list(itertools.combinations(range(4), 2)) + [(3, 4), (4, 5)]
    got = {r.node: r.core for r in features.core_numbers(graph(spark, pairs)).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1, 5: 1}


def test_core_numbers_by_peeling(spark):
    """Trees on rings on cliques, against peeling a node at a time."""
    rng = random.Random(3)
    pairs = [(i, rng.randrange(i)) for i in range(1, 60)] + list(itertools.combinations(range(60, 66), 2)) + [(60, 5), (70, 71), (71, 72), (72, 70), (72, 73), (80, 81)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(25)]
    e = graph(spark, pairs)
    near = {}
    for r in e.collect():
        near.setdefault(r.src, set()).add(r.dst)
    want, left, k = {}, {v: len(n) for v, n in near.items()}, 0
    while left:
        v = min(left, key=left.get)
        k = max(k, left.pop(v))
        want[v] = k
        for w in near[v] & left.keys():
            left[w] -= 1
    assert {r.node: r.core for r in features.core_numbers(e).collect()} == want


def test_core_numbers_of_a_long_path(spark):
    n = 100_000
    scattered = ((F.col("id") * 48271) % 2147483647).alias("a"), (((F.col("id") + 1) * 48271) % 2147483647).alias("b")
    e = io.symmetric(io.canonical(spark.range(n - 1).select(*scattered)))
    out = features.core_numbers(e)
    assert out.count() == n and out.filter("core <> 1").isEmpty()


def test_two_hops_by_listing(spark):
    rng = random.Random(6)
    pairs = [(0, i) for i in range(1, 90)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(300)]
    e = graph(spark, pairs)
    near = {}
    for r in e.collect():
        near.setdefault(r.src, set()).add(r.dst)
    for r in features.two_hops(e).collect():
        far = [w for m in near[r.node] for w in near[m] if w != r.node and w not in near[r.node]]
        assert (r.reach2_paths, r.reach2_nodes) == (len(near[r.node]) + len(far), len(near[r.node]) + len(set(far)))


def test_draws_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(0)
    p = rng.random((3, 200)) * (rng.random((3, 200)) < 0.7)
    rows = spark.createDataFrame([(t, n, float(x)) for t, r in enumerate(p / p.sum(1, keepdims=True)) for n, x in enumerate(r)], "target long, node long, p double").cache()
    whole = sorted(map(tuple, estimate.draw_pivots(rows, 40, 5).collect()))
    assert len(whole) == 120 and all(x[3] > 0 for x in whole)
    for block in (50, 7):
        assert sorted(map(tuple, estimate.draw_pivots(rows, 40, 5, block=block).collect())) == whole


def test_generators(spark):
    rng = np.random.default_rng(0)
    e = generators.erdos_renyi(200, 0.05, rng)
    assert (e[:, 0] < e[:, 1]).all() and len(np.unique(e, axis=0)) == len(e) and 800 < len(e) < 1200
    assert len(generators.erdos_renyi(5, 1.0, rng)) == 10
    ba = generators.preferential(50, 3, rng)
    assert len(ba) == 3 + 47 * 3 and ba.max() == 49
    cat = generators.random_catalogue(spark, 6, 20, 40)
    g = generators.with_hubs(generators.generate(cat))
    assert g.select("graph_id").distinct().count() == 6
    assert sorted(map(tuple, generators.generate(cat).collect())) == sorted(map(tuple, generators.generate(cat).collect()))


def test_draws_invert_the_running_sum(spark):
    p = spark.createDataFrame([(9, 1, 0.25), (9, 2, 0.5), (9, 5, 0.25)], "target long, node long, p double")
    got = estimate.draw_pivots(p, 2000, 3).groupBy("node").count().collect()
    share = {r.node: r["count"] / 2000 for r in got}
    assert share[1] == pytest.approx(0.25, abs=0.05) and share[2] == pytest.approx(0.5, abs=0.05)


def test_trimmed_and_adaptive(spark):
    v = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate([1, 2, 3, 4, 100], 1)] + [(2, 1, 5.0)], "target long, t int, value double")
    got = {r.target: r.est for r in estimate.trimmed_estimates(v, scale=1.0).collect()}
    assert got == {1: 3.0, 2: 5.0}
    flat = spark.createDataFrame([(1, t, 2.0) for t in range(1, 11)], "target long, t int, value double")
    assert [(r.used, r.est) for r in estimate.adaptive_estimates(flat, scale=1.0).collect()] == [(5, 2.0)]


def test_rank_agreement_by_brute_force(spark):
    rng = random.Random(2)
    data = [(i, float(rng.randrange(6)), float(rng.randrange(5))) for i in range(40)]
    got = metrics.rank_agreement(spark.createDataFrame([("g", *r) for r in data], "graph string, node long, bc double, score double"), ["graph"]).first()
    nodes = [r for r in data if r[1] > 0]
    pairs = [(a, b) for a, b in itertools.combinations(nodes, 2)]
    differ = [(a, b) for a, b in pairs if a[1] != b[1]]
    assert got.xi == pytest.approx(sum((a[2] > b[2]) == (a[1] > b[1]) for a, b in differ) / len(differ))
    s = sum(np.sign(a[1] - b[1]) * np.sign(a[2] - b[2]) for a, b in pairs)
    tx, ty = sum(a[1] != b[1] for a, b in pairs), sum(a[2] != b[2] for a, b in pairs)
    assert got.kendall == pytest.approx(s / np.sqrt(tx * ty))


def test_pairs_are_counted_as_by_all_pairs():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 64, 150):
        y, w, g = rng.integers(0, 12, n).astype(float), rng.integers(1, 4, n), np.sort(rng.integers(0, 3, n))
        want = [sum(int(w[i] * w[j]) for i in range(j) if y[i] < y[j] and g[i] == g[j]) for j in range(n)]
        assert concordance.ascents(g, y, w).tolist() == want


@pytest.mark.parametrize("block", [10**6, 60, 17])
def test_concordant_pairs_over_ranges(spark, block):
    """Groups of all sizes, one of most rows, ties, and a value that a third of the rows share."""
    rng = random.Random(4)
    data = [("large" if i % 3 else f"g{i % 30}", rng.choice([5.0, rng.randrange(30) / 2]), rng.choice([1, 1, rng.randrange(40)])) for i in range(500)] + [("one", 1.0, 1)]
    rows = spark.createDataFrame(data, "grp string, a double, b int").repartition(4)
    got = {r.grp: r.ascents for r in concordance.concordant(rows, ["grp"], "a", "b", block).collect()}
    want = {}
    for g in {d[0] for d in data}:
        own = [d for d in data if d[0] == g]
        want[g] = sum((x[1] - y[1]) * (x[2] - y[2]) > 0 for x, y in itertools.combinations(own, 2))
    assert got == want
    assert {r.grp: r.t for r in concordance.tied(rows, ["grp"], ["a", "b"], "t").collect()}["large"] == sum(x == y for x, y in itertools.combinations([d for d in data if d[0] == "large"], 2))


def test_rank_agreement_of_groups_over_ranges(spark, monkeypatch):
    """Groups by themselves and together, in one range and in many."""
    rng = random.Random(8)
    data = [(g, i, float(rng.randrange(9)), float(rng.randrange(7))) for g in "abc" for i in range(rng.randrange(15, 60))] + [("few", 0, 1.0, 2.0), ("few", 1, 2.0, 3.0)]
    rows = spark.createDataFrame(data, "graph string, node long, bc double, score double").cache()
    whole = {r.graph: tuple(r)[1:] for r in metrics.rank_agreement(rows, ["graph"]).collect()}
    monkeypatch.setattr(concordance, "BLOCK", 20)
    cut = {r.graph: tuple(r)[1:] for r in metrics.rank_agreement(rows, ["graph"]).collect()}
    assert cut.keys() == whole.keys() == {"a", "b", "c", "few"} and all(cut[g] == pytest.approx(whole[g]) for g in cut)
    for g in "abc":
        alone = metrics.rank_agreement(rows.filter(F.col("graph") == g), ["graph"]).first()
        assert tuple(alone)[1:] == pytest.approx(whole[g])
        assert metrics.spearman(rows.filter((F.col("graph") == g) & (F.col("bc") > 0)), "bc", "score").first().rho == pytest.approx(whole[g][3])
    assert whole["few"] == (2, 1, 1.0, 0.0, 0.0)


def test_graphs_deeper_than_the_bound_raise(spark, monkeypatch):
    monkeypatch.setattr(traverse, "MOST_LEVELS", 3)
    e = graph(spark, [(i, i + 1) for i in range(8)])
    with pytest.raises(RuntimeError):
        traverse.bfs(e, spark.createDataFrame([(0,)], "s long"), "joins")


def test_all_zero_values_give_full_agreement(spark):
    df = spark.createDataFrame([("g", 0, 0.0, 1.0), ("h", 0, 1.0, 1.0)], "graph string, node long, bc double, score double")
    assert [(r.graph, r.xi) for r in metrics.rank_agreement(df, ["graph"]).collect()] == [("h", 1.0)]


def test_graph_sage_gradient_and_forward(spark, tmp_path):
    pairs = HAND["triangles"][0]
    n, rng = 6, np.random.default_rng(0)
    adj = np.zeros((n, n))
    for a, b in pairs:
        adj[a, b] = adj[b, a] = 1
    mean = adj / adj.sum(1, keepdims=True)
    x = rng.normal(size=(n, 3))
    u, v, y = np.array([0, 2, 3]), np.array([2, 4, 5]), np.array([0.0, 1.0, 1.0])
    model, losses = models.train_graph_sage([(x, mean, u, v, y)], epochs=60, rate=0.01)
    assert losses[-1] < losses[0] * 0.5
    h, _ = model.embed(x, mean)
    e = graph(spark, pairs)
    got = model.transform(e, spark.createDataFrame([(i, [float(k) for k in x[i]]) for i in range(n)], "node long, h array<double>"))
    assert np.allclose(np.stack([r.h for r in got.orderBy("node").collect()]), h)
    prob = [r.prob for r in model.score(got, spark.createDataFrame([(2, 4)], "u long, v long")).collect()]
    assert prob[0] > 0.5
    model.save(spark, str(tmp_path / "m"))
    again = models.GraphSage.load(spark, str(tmp_path / "m"))
    assert np.allclose(again.embed(x, mean)[0], h)


def test_graph_convolution_matches_numpy(spark):
    pairs = HAND["triangles"][0]
    n, rng = 6, np.random.default_rng(1)
    adj = np.zeros((n, n))
    for a, b in pairs:
        adj[a, b] = adj[b, a] = 1
    d = adj.sum(1)
    x, w, bias = rng.normal(size=(n, 3)), rng.normal(size=(3, 8)), rng.normal(size=8)
    want = np.maximum((adj / np.sqrt(np.outer(d, d)) + np.eye(n)) @ x @ w + bias, 0)
    e = graph(spark, pairs)
    h = spark.createDataFrame([(i, [float(k) for k in x[i]]) for i in range(n)], "node long, h array<double>")
    got = models.graph_convolution(features.normalised_adjacency(e), h, w, bias)
    assert np.allclose(np.stack([r.h for r in got.orderBy("node").collect()]), want)


def test_soft_vote_and_splits(spark):
    rng = random.Random(3)
    rows = [(i, rng.random(), rng.random()) for i in range(120)]
    df = spark.createDataFrame([(i, a, b, int(a > b)) for i, a, b in rows], "id long, a double, b double, y int")
    vote = models.SoftVote(["a", "b"], trees=5, depth=3, hidden=(4,), epochs=30).fit(df)
    out = vote.transform(df)
    assert out.filter("(prob > 0.5) = (y = 1)").count() > 100
    parts = {r.part: r["count"] for r in datasets.split(df, "id", 0.25, by="y").groupBy("part").count().collect()}
    assert abs(parts["test"] - 30) <= 1
    assert datasets.repeated(df, 8).count() == 960


def test_checkpoint_choice_and_scraping(spark):
    e = spark.createDataFrame([(1, 0.8, 0.5, None, None), (2, None, None, None, None), (3, 0.7, 0.5, 0.9, 0.9)], "epoch int, val_acc double, rho double, real_acc double, real_rho double")
    assert metrics.best_checkpoint(e).first().epoch == 3
    lines = spark.createDataFrame([("T=25 efficiency 0.91",), ("noise",)], "value string")
    assert [tuple(r) for r in metrics.scraped(lines, r"T=(\d+) efficiency ([\d.]+)", ["t", "xi"]).collect()] == [("25", "0.91")]


def shallow(kind, n=300):
    """Edges both ways of a connected graph of few levels: of two sides with hubs, of no sides, a star, a clique with tails."""
    rng = np.random.default_rng(3)
    if kind == "sides":
        pairs = [(2 * int(a), 2 * int(b) + 1) for a, b in zip(rng.integers(0, n, 4 * n), rng.integers(0, n // 2, 4 * n))] + [(0, 2 * b + 1) for b in range(n // 2)] + [(2 * a, 1) for a in range(n)]
    elif kind == "none":
        pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (3 * n, 2)) if a != b] + [(i, (i + 1) % n) for i in range(n)]
    elif kind == "star":
        pairs = [(0, i) for i in range(1, 20 * n)]
    else:
        pairs = [(a, b) for a in range(n // 2) for b in range(a)] + [(a, a + n) for a in range(n // 2)]
    return np.array(sorted({p for a, b in pairs for p in ((a, b), (b, a))}))


@pytest.mark.parametrize("kind", ["sides", "none", "star", "clique"])
def test_matrices_find_what_slots_find(kind):
    """For all sources and for some; a part of few levels took a search of slots for each source."""
    e = shallow(kind)
    g = traverse.Adjacency(e[:, 0], e[:, 1], np.zeros(len(e), int))
    for sources in (np.arange(len(g.ids)), np.random.default_rng(0).permutation(len(g.ids))[:37]):
        made = traverse.DenseSearches.of(g, sources)
        assert made is not None and (made.size[1] > 0) == (kind in ("sides", "star"))
        want = np.zeros(len(g.ids))
        for s in g.searches(sources):
            np.add.at(want, s.place, s.dependencies())
        assert np.allclose(g.totals(sources), want, rtol=1e-12, atol=1e-9)


def test_a_shallow_part_is_searched_once_by_slots(monkeypatch):
    """Small, deep and unconnected ones still are, for each source."""
    seen = []

    class Counted(traverse.Searches):
        def __init__(self, g, sources):
            seen.append(len(sources))
            super().__init__(g, sources)

    monkeypatch.setattr(traverse, "Searches", Counted)
    n, flat = 300, shallow("none")
    ring = np.array([p for i in range(n) for p in ((i, (i + 1) % n), ((i + 1) % n, i))]) + 1000
    few = np.array([(2000, 2001), (2001, 2000)])
    e = np.concatenate([flat, ring, few])
    g = traverse.Adjacency(e[:, 0], e[:, 1], np.repeat([0, 1, 2], [len(flat), len(ring), len(few)]))
    total = g.totals(np.arange(len(g.ids)))
    assert sum(seen) == 1 + 1 + n + 2 and total[n : 2 * n] == pytest.approx(np.full(n, total[n])) and not total[2 * n :].any()
