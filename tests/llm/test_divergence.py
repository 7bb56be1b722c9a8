import collections
import random
import re

import pytest

from betwixt.llm import divergence
from betwixt.llm.queries import op13_baseline_divergence, oracle_sql

from ..util import same
from .util import corpus, documents, empty

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, top=10):
    """All pairs and terms of (lang, source, text), by their definition."""
    occurs, docs, groups = collections.Counter(), collections.Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups.add((lang, source))
        occurs.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    kept = collections.defaultdict(list)
    for (lang, t), n in docs.items():
        if n >= least:
            kept[lang].append(t)

    def given(lang, count):
        total, v = sum(map(count, kept[lang])), len(kept[lang])
        return {t: 1 + 10**9 * (count(t) + 2) // (total + 2 * v) for t in kept[lang]}

    p = {g: given(g[0], lambda t, g=g: occurs[*g, t]) for g in groups}
    q = {lang: given(lang, lambda t, lang=lang: sum(occurs[*g, t] for g in groups if g[0] == lang)) for lang, _ in groups}

    def apart(a, b):
        return (a - b) ** 2 // (a + b)

    out = set()
    for g in groups:
        parts = {
            "pair": [(h[1], sum(apart(p[g][t], p[h][t]) for t in kept[g[0]])) for h in groups if h[0] == g[0] and h != g],
            "term": [(t, apart(p[g][t], q[g[0]][t])) for t in kept[g[0]] if occurs[*g, t] and p[g][t] > q[g[0]][t]],
        }
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(*g, part, item, value, i) for i, (item, value) in enumerate(items[: None if part == "pair" else top], 1)}
    return out


def made(seed=3):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "ÉTÉ", "été", "straße", "日本", "x", "Rare"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "é"]), " ".join(rng.choice(words[: rng.randrange(2, len(words))]) for _ in range(rng.randrange(40)))) for _ in range(150)]
    return rows + [("de", "alone", "no term is kept here"), ("it", "a", "once"), ("it", "b", None), ("", "", "")] + rows[:9]


@pytest.mark.parametrize("broadcast", [10**5, 0])
def test_by_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(divergence, "MOST_BROADCAST", broadcast)
    rows = made()
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "lang string, source string, text string, item string").repartition(4)
    got = [tuple(r) for r in divergence.divergences(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert {r[:3] for r in got if r[0] == "it"} == {("it", "a", "pair"), ("it", "b", "pair")}


def test_awkward_rows(spark):
    rows = [(r[2], r[3], r[1]) for r in corpus()]
    assert {tuple(r) for r in divergence.divergences(documents(spark)).collect()} == brute(rows)
    assert divergence.divergences(empty(spark)).count() == 0


def test_tables_are_bounded(monkeypatch):
    """Parts and flushes change neither occurrences nor the documents of a term."""
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 4))) for _ in range(n)).encode() for n in (3, 50, 3000, 1, 700)] + [b"", b"z" * 500, b" ,;9" * 200]

    def totals():
        held, n, docs, most = divergence.Tables(), collections.Counter(), collections.Counter(), 0
        batches = []
        for i, t in enumerate(texts):
            batches += held.add("en", str(i % 2), t)
            most = max(most, held.size)
        for b in [*batches, *held.rows()]:
            for _, source, term, many, documents in zip(*b.to_pydict().values()):
                n[source, term] += many
                docs[term] += documents
        return +n, +docs, most

    want = totals()
    monkeypatch.setattr(divergence, "PART", 100)
    monkeypatch.setattr(divergence, "ENTRIES", 40)
    got = totals()
    assert got[:2] == want[:2] and got[2] < want[2]


def test_large_counts_are_exact(spark):
    n, total, kept = 9_000_000_000_000_000_001, 9_100_000_000_000_000_007, 1_000_003
    row = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long").selectExpr(divergence.given("n", "total", "kept")).first()
    assert row[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    same(op13_baseline_divergence, oracle_sql()["op13_baseline_divergence"], spark, sf)
