"""Language identification, cross-entropy difference and toxicity."""

import collections
import itertools
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from betwixt.llm import langid, lmscore, toxicity
from betwixt.llm.queries import op6_rank_order_language, op8_crf_toxicity

from .util import corpus, documents, empty

SF = "/root/testdata/sf0.1"


def accuracy(rows, truth, pred):
    return sum(r[truth] == r[pred] for r in rows) / len(rows)


def test_languages_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = op6_rank_order_language(spark, SF).collect()
    assert len(out) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.99


def test_ranks_by_brute_force():
    for text in ("Abba abba, banana! É é", "a", "zz zz zz zq"):
        c = langid.encode(text).tolist()
        n = collections.Counter(itertools.chain(((1 << 18) | x for x in c if x), ((2 << 18) | a << 6 | b for a, b in zip(c, c[1:])), ((3 << 18) | x << 12 | y << 6 | z for x, y, z in zip(c, c[1:], c[2:]))))
        for k in (5, 400):
            assert langid.ranked(text, k).tolist() == [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:k]]


def test_predictions_by_brute_force(spark):
    """Profiles, distances, predictions and scores of the table, by dictionaries."""
    d, k = "/root/testdata/sf0.001", langid.K
    rows = [r for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang").collect() if len(r.text) < 20_000]

    def counts(text):
        c = langid.encode(text).tolist()
        grams = [tuple(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1)]
        return collections.Counter(g for g in grams if g != (0,))

    def top(n):
        return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:k]]

    learnt = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and any(langid.encode(r.text)):
            learnt.setdefault(r.lang, collections.Counter()).update(counts(r.text))
    profile = {lang: {g: i for i, g in enumerate(top(n))} for lang, n in sorted(learnt.items())}
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.language_table(docs).collect()}
    for r in rows:
        if not any(langid.encode(r.text)):
            assert out[r.doc_id].lang_pred == "und"
            continue
        g = top(counts(r.text))
        far = {lang: sum(min(abs(p[x] - i), k) if x in p else k for i, x in enumerate(g)) for lang, p in profile.items()}
        best = min(far, key=lambda x: (far[x], x))
        assert (out[r.doc_id].lang_pred, out[r.doc_id].score) == (best, pytest.approx(1 - far[best] / (k * len(g))))


def test_languages_of_awkward_rows(spark):
    out = langid.language_table(documents(spark)).collect()
    assert len(out) == len(corpus())
    by = {r.doc_id: r for r in out}
    for i in (30, 31, 32, 33, 34):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert langid.language_table(empty(spark)).count() == 0
    untaught = langid.language_table(documents(spark).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang"))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_cross_entropy_prefers_the_target(spark):
    """Also of documents whose labels it has not seen: the target learns from one half of the labels."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("pmod(hash(doc_id), 2) = 0")
    for target, among in ((labels, labels), (seen, labels.join(seen, "doc_id", "left_anti"))):
        out = {r.doc_id: r.score for r in lmscore.cross_entropy_difference(docs, target).collect()}
        good, bad = (np.array([out[r.doc_id] for r in among.collect() if r.quality == q]) for q in (1, 0))
        assert (good[:, None] > bad[None]).mean() > 0.8


def test_cross_entropy_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (3, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    out = lmscore.cross_entropy_difference(documents(spark), labels).collect()
    assert len(out) == len(corpus())
    assert all((r.n_tokens, r.score) == (0, 0.0) for r in out if r.doc_id in (30, 31, 33, 34))
    assert lmscore.cross_entropy_difference(empty(spark), labels).count() == 0
    assert {r.score for r in lmscore.cross_entropy_difference(documents(spark), labels.limit(0)).collect()} == {0.0}


def test_word_models_by_brute_force(spark, monkeypatch):
    """Statistics are words and marks of any number, so that texts with the same character classes differ."""
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", 60)
    monkeypatch.setattr(lmscore, "BUCKET_BYTES", 40)
    texts = [f"total {i} of item {i * 7}; {'cost' if i % 3 else 'price'} = {i % 5}!" for i in range(40)] + ["total 1 of item 7; cost = 1!", "total 2 of item 9; cost = 3?"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i % 4 == 1), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    split = [re.findall(r"[a-z0-9]+|[^\sa-z0-9]", t) for t in texts]

    def model(docs):
        one = collections.Counter(w for d in docs for w in d)
        two = collections.Counter(x for d in docs for x in zip(["", *d], d))
        after = collections.Counter(x for d in docs for x in ["", *d[:-1]])
        v = len({w for d in split for w in d})

        def p(a, b):
            low = (one[b] + len(one) / v) / (sum(one.values()) + len(one))
            return (two[a, b] + lmscore.PRIOR * low) / (after[a] + lmscore.PRIOR)

        return p

    t, b = model([d for i, d in enumerate(split[:40]) if i % 4 == 1]), model(split)
    out = {r.doc_id: r for r in lmscore.cross_entropy_difference(documents(spark, rows), labels).collect()}
    for i, d in enumerate(split):
        assert out[i].n_tokens == len(d)
        assert out[i].score == pytest.approx(np.mean([math.log(t(x, y) / b(x, y)) for x, y in zip(["", *d], d)]), abs=1e-9)
    assert abs(out[40].score - out[41].score) > 0.01


def test_forward_backward_by_brute_force():
    rng = np.random.default_rng(0)
    m = toxicity.Model(step=np.array([[0.3, -0.4], [-0.2, 0.9]]), start=0.5)
    first = np.array([0, 4, 4, 5, 8])
    e = rng.normal(size=8)
    want = np.zeros(8)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        total, hit = 0.0, np.zeros(hi - lo)
        for y in itertools.product((0, 1), repeat=int(hi - lo)):
            s = sum(e[lo + i] for i in range(hi - lo) if y[i]) + (m.start if y and y[0] else 0) + sum(m.step[a, b] for a, b in zip(y, y[1:]))
            total += math.exp(s)
            hit += math.exp(s) * np.array(y)
        want[lo:hi] = hit / total
    assert np.allclose(m.marginals(e, first), want)


def test_long_texts_have_the_same_marginals_as_a_plain_loop():
    rng = np.random.default_rng(1)
    m = toxicity.Model(step=np.array([[0.1, -0.5], [-0.3, 0.8]]), start=-0.2)
    e, n = rng.normal(-2, 2, 5000), 5000
    a = np.exp(m.step)
    fwd, bwd = np.zeros((n, 2)), np.ones((n, 2))
    fwd[0] = [1, math.exp(e[0] + m.start)]
    for t in range(1, n):
        fwd[t] = fwd[t - 1] @ a * [1, math.exp(e[t])]
        fwd[t] /= fwd[t].sum()
    for t in range(n - 2, -1, -1):
        bwd[t] = a @ (bwd[t + 1] * [1, math.exp(e[t + 1])])
        bwd[t] /= bwd[t].sum()
    p = fwd * bwd
    assert np.allclose(m.marginals(e, np.array([0, n])), p[:, 1] / p.sum(1))


def test_toxicity_of_held_out_documents(spark):
    out = {r.doc_id: r for r in op8_crf_toxicity(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [(r.toxic, out[r.doc_id].predicted) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if out[r.doc_id].held_out]
    hit = sum(t and p for t, p in held)
    assert sum(t == p for t, p in held) / len(held) > 0.96
    assert hit / sum(p for _, p in held) > 0.9 and hit / sum(t for t, _ in held) > 0.8


def test_toxic_spans_are_offsets_of_the_text(spark):
    good = [(i, f"quiet words number {i} of a plain text É", "en", "s", 1) for i in range(60)]
    bad = [(100 + i, f"É quiet NASTYWORD words number {i}", "en", "s", 1) for i in range(60)]
    labels = spark.createDataFrame([(r[0], 1, int(r[0] >= 100)) for r in good + bad], "doc_id long, quality int, toxic int")
    docs = documents(spark, good + bad + corpus()[-10:])
    for r in toxicity.toxicity_table(docs, labels).collect():
        if r.doc_id is not None and 100 <= r.doc_id < 200:
            assert r.predicted == 1 and r.spans == "8:17"
        else:
            assert r.predicted == 0 and r.spans == ""
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 70


def test_toxicity_of_awkward_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (3, None, 7)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity_table(documents(spark), labels).collect()
    assert len(out) == len(corpus()) and all(r.score < 1e-5 and r.predicted == 0 for r in out)
    assert toxicity.toxicity_table(documents(spark), labels.limit(0)).count() == len(corpus())
    assert toxicity.toxicity_table(empty(spark), labels).count() == 0
    assert toxicity.reject_toxic(empty(spark), labels).count() == 0


def test_a_giant_toxic_document_leaves_the_rest_in_the_sample(spark):
    most_bytes = {0: 1 << 20, 1: 20_000}
    ids = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5]
    giant = spark.createDataFrame([(i,) for i in ids], "i long").orderBy(F.xxhash64("i"), "i").first().i
    good = [(i, f"quiet words number {i} of a plain text", "en", "s", 1) for i in range(60)]
    bad = [(i, f"quiet NASTYWORD words number {i}" + " plain text" * (3000 if i == giant else 0), "en", "s", 1) for i in ids]
    labels = spark.createDataFrame([(r[0], 1, int(r[0] >= 100)) for r in good + bad], "doc_id long, quality int, toxic int")
    sample, _ = toxicity.pick_sample(documents(spark, good + bad), labels, toxicity.SAMPLE, most_bytes)
    assert sample.filter("toxic = 1").count() == len(ids) - 1
    model = toxicity.fit(documents(spark, good + bad), labels, most_bytes=most_bytes)
    out = toxicity.score_documents(documents(spark, good + bad).selectExpr("doc_id", "text", "1 AS `a.b`"), model, ["doc_id", "a.b"]).collect()
    assert all(r.predicted == int(r.doc_id >= 100) for r in out)


def test_memory_of_training():
    """One task trains while its executor's JVM and another worker hold their memory."""
    rng = np.random.default_rng(3)
    vocabulary = rng.integers(1, 1 << 63, (toxicity.OWN, 400_000)).astype(np.uint64)
    rows = [(int(i < 300), np.ascontiguousarray(vocabulary[:, rng.integers(0, 400_000, 500)])) for i in range(1200)]
    tokens = sum(own.shape[1] for _, own in rows)
    tracemalloc.start()
    toxicity.trained(rows, {0: 900, 1: 300}, 2, 900)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 180 * tokens, peak / tokens
