import itertools
import random
import re

import numpy as np
import pytest

from betwixt.llm import graphs, simjoin
from betwixt.llm.queries import op3_chosen_path_join

from .util import changed, corpus, documents, empty, prose

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def shingles(text):
    w = WORD.findall(text.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([text])


def brute(rows):
    """(links, class) of each row by comparing all pairs."""
    sets = [None if r[1] is None else shingles(r[1]) for r in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a is not None and b is not None and len(a & b) / len(a | b) >= 0.8 - 1e-12:
            links[i] += 1
            links[j] += 1
            parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return links, [least.get(find(i)) for i in range(len(rows))]


def test_same_as_brute_force(spark):
    rows = corpus()
    links, classes = brute(rows)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in simjoin.linked(documents(spark, rows)).collect()), key=str)
    # a row with a null id that no other row links to has no class of an id
    want = sorted(((r[0], c if c is not None else r[0], n) for r, n, c in zip(rows, links, classes, strict=True)), key=str)
    assert got == want


def test_large_group_of_near_copies(spark):
    base = prose(120, 1)
    rng = random.Random(5)
    rows = [(i, changed(base, [rng.randrange(120) for _ in range(rng.randrange(4))]), "en", "s", 1) for i in range(400)]
    links, classes = brute(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in simjoin.linked(documents(spark, rows), block=32).collect()}
    assert got == {r[0]: (c, n) for r, n, c in zip(rows, links, classes, strict=True)}


def test_query_on_the_table(spark):
    out = op3_chosen_path_join(spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    links, classes = brute(rows)
    assert {r.doc_id: (r.n_links, r.class_id) for r in out} == {r[0]: (n, c) for r, n, c in zip(rows, links, classes, strict=True)}


def test_empty(spark):
    assert simjoin.linked(empty(spark)).count() == 0
    assert simjoin.deduplicate(empty(spark)).count() == 0


def test_deduplicate_keeps_one_of_each_class(spark):
    rows = corpus()
    _, classes = brute(rows)
    kept = [r.doc_id for r in simjoin.deduplicate(documents(spark, rows)).collect()]
    want = {c if c is not None else r[0] for r, c in zip(rows, classes, strict=True) if r[0] is not None}
    assert sorted(x for x in kept if x is not None) == sorted(want)
    assert kept.count(None) == 1
    assert simjoin.deduplicate(documents(spark, rows)).columns == documents(spark, rows).columns


def test_deduplicate_of_repeated_and_null_ids(spark):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 2), (2, b, "en", "s", 3), (2, b, "fr", "s", 3), (2, b.upper(), "en", "s", 4), (3, changed(b, [0]), "en", "s", 5), (None, a, "en", "s", 6), (4, None, "en", "s", 7), (4, None, "en", "s", 7)]
    docs = documents(spark, rows).selectExpr("*", "1 AS `a.b`", "2 AS turn", "3 AS h", "4 AS stays", "5 AS vid")
    out = simjoin.deduplicate(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text and r.text.lower()) for r in out.collect()), key=str)
    # id 2 keeps its other text, once; the copy of id 1 goes, and rows without an id or a text stay
    assert got == sorted([(1, a), (2, b), (None, a), (4, None), (4, None)], key=str)
    links = {(r.doc_id, r.n_links) for r in simjoin.linked(documents(spark, [(None, a, "en", "s", 1), (None, changed(a, [0]), "en", "s", 1)])).collect()}
    assert links == {(None, 1)}


def test_words_that_collide_modulo_two_to_the_64(spark):
    x = "a"
    while len(x) < 4096:
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    out = simjoin.linked(documents(spark, [(1, x, "en", "s", 1), (2, y, "en", "s", 1)])).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in out} == {(1, 1, 0), (2, 2, 0)}


def test_roots():
    rng = np.random.default_rng(0)
    near = rng.random((40, 40)) < 0.02
    near |= near.T
    reach = near | np.eye(40, dtype=bool)
    for _ in range(6):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert simjoin.roots(near).tolist() == reach.argmax(1).tolist()


def test_runs_follow_the_recall():
    assert simjoin.runs_for(0.999, 3) == 15
    assert simjoin.runs_for(0.9, 1) < simjoin.runs_for(0.9, 3)


def test_recall_of_pairs_that_need_three_levels():
    n, t = 10_000, simjoin.T
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, (n, t), dtype=np.uint32)
    b = np.where(rng.random((n, t)) < 0.8, a, rng.integers(0, 2**32, (n, t), dtype=np.uint32))
    roots = max(simjoin.runs_for(0.999, 3), simjoin.roots_for(0.999, 3, 0.8))
    paths = zip(simjoin.root_children(a, roots), simjoin.root_children(b, roots), strict=True)
    pairs = [(np.flatnonzero(x == y), x[x == y]) for x, y in paths]
    assert len(pairs) == roots and all(0.75 < len(p) / n < 0.85 for p, _ in pairs)
    pair, node = (np.concatenate(x) for x in zip(*pairs))
    for _ in range(2):
        # nodes hold one pair each here: draws per pair and node, as for other pairs of a large node
        (ra, ca), (rb, cb) = (simjoin.children(node, s[pair], 0.8) for s in (a, b))
        assert (ra == rb).all()
        pair, node = pair[ra[ca == cb]], ca[ca == cb]
    assert 1 - len(np.unique(pair)) / n <= 0.002


def test_components(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (10, 11), (11, 12), (12, 13), (13, 14), (7, 7)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4, 11: 10, 12: 10, 13: 10, 14: 10}


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, n)).astype(np.uint64) for n in (5, 20, 40, 1, 30, 12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = simjoin.shared_counts(sets)
    for i, j in itertools.permutations(range(len(sets)), 2):
        assert got[i, j] == want[i][j]
    assert simjoin.shared_counts(sets[:3])[0, 2] == want[0][2]


@pytest.mark.parametrize("n", [1, 5])
def test_minhash_estimates_similarity(n):
    rng = np.random.default_rng(n)
    a = np.unique(simjoin.mix(rng.integers(0, 2**62, 400).astype(np.uint64)))
    b = np.concatenate([a[:300], simjoin.mix(rng.integers(0, 2**62, 100).astype(np.uint64))])
    sk = simjoin.minhashes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert (sk[0] == sk[1]).mean() == pytest.approx(300 / 500, abs=0.15)
