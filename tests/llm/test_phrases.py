import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from betwixt.llm import phrases
from betwixt.llm.queries import op11_contiguous_phrases, oracle_sql

from ..util import same
from .util import corpus, documents, empty

LOWER = {c: c + 32 for c in range(65, 91)}


def counts(rows):
    """(lang, words) to occurrences, of phrases of one to four words."""
    f = collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            f.update((lang if lang is not None else "und", tuple(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    return f


def brute(rows):
    f = counts(rows)
    n = collections.Counter()
    for (lang, w), c in f.items():
        n[lang] += c * (len(w) == 1)
    candidates = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= 30}
    hidden = set()
    for (lang, w), c in candidates.items():
        for m in range(2, len(w)):
            hidden |= {(lang, w[i : i + m]) for i in range(len(w) - m + 1) if 100 * c >= 80 * candidates[lang, w[i : i + m]]}
    best = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in hidden:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, l, r = min(cuts)
            best[lang].append((-score, -a, " ".join(w).encode(), a, l, r))
    return {(lang, i, p.decode(), a, l, r, n[lang], -s) for lang, x in best.items() for i, (s, _, p, a, l, r) in enumerate(sorted(x)[:2000], 1)}


def made(seed=5):
    rng = random.Random(seed)
    words = ["A", "b", "c\x01", "c", "É", "é", "#1", "d", "e-f", "日本"]
    rows = [(rng.choice(["en", "en", "fr", None]), "".join(rng.choice(words[: rng.randrange(2, 11)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n"]) for _ in range(rng.randrange(60)))) for _ in range(500)]
    return rows + [("und", "a b a b a b"), ("", "a b"), ("en", None), ("de", "only here"), ("en", "x y z! " * 40), ("fr", "p q r s " * 33)] + rows[:5]


@pytest.mark.parametrize("hot", [4096, 10**9])
def test_by_brute_force(spark, monkeypatch, hot):
    """Also where every pair is so frequent that its table is dealt by longer prefixes."""
    monkeypatch.setattr(phrases, "HOT", hot)
    rows = made()
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "lang string, text string, words string").repartition(5)
    got = [tuple(r) for r in phrases.collocations(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 60


def test_awkward_rows(spark):
    rows = corpus()
    assert {tuple(r) for r in phrases.collocations(documents(spark, rows)).collect()} == brute([(r[2], r[1]) for r in rows])
    assert phrases.collocations(empty(spark)).count() == 0


def test_words_spelt_as_their_language(spark):
    """Hashes of a word and of its language's name must not cancel out: phrases of such words met across languages and lengths."""
    rows = [(lang, f"{lang} {lang} {lang} {lang} x. {lang} {lang} {lang} y. z {lang} {lang}") for lang, n in (("en", 40), ("de", 31), ("a b ", 33)) for _ in range(n)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = [tuple(r) for r in phrases.collocations(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 10


def runs(rows, batch):
    """Frequent phrases of pairs, and of longer ones by sorted batches of ``batch`` rows."""
    every, none, held = np.full(1 << 20, -1, np.int64), np.zeros(0, np.uint64), {2: [], 3: []}
    for least in held:
        for lang, text in rows:
            held[least] += [phrases.windows([(lang or "und", part, end)], every, none, least) for part, end in phrases.parts((text or "").encode().translate(phrases.PLAIN), 3)]
    pairs = collections.Counter()
    for b in held[2]:
        for lang, words, n in zip(*(b.column(i).to_pylist() for i in range(3))):
            pairs[lang, words] += n
    out = [(lang, w[:-1], 2, n) for (lang, w), n in pairs.items() if n >= 30]
    table = pa.Table.from_batches(held[3]).sort_by([("lang", "ascending"), ("words", "ascending")]).select(["lang", "words", "n"])
    open_runs = phrases.Runs()
    for at in range(0, len(table), batch):
        out += open_runs.rows(table.slice(at, batch).combine_chunks().to_batches()[0])
    out += open_runs.rest()
    assert all(len(p.split(b" ")) == m for _, p, m, _ in out)
    return {(lang, tuple(p.decode().split(" "))): n for lang, p, _, n in out}, len(out)


@pytest.mark.parametrize("chunk", [1 << 20, 64, 7])
@pytest.mark.parametrize("batch", [10**6, 50, 1])
def test_long_texts_and_batches(monkeypatch, chunk, batch):
    """Neither the parts of a long text nor the batches of a task change a count."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = made(9)[: 60 if batch == 1 else 200] + [("en", "long" * 50 + " word " + "a b c d " * 100)]
    want = {k: c for k, c in counts(rows).items() if len(k[1]) > 1 and c >= 30}
    got, many = runs(rows, batch)
    assert got == want and many == len(want)


def test_parts_join_to_the_text(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 10)
    for text in (b"", b" ", b"one two\nthree  four five six seven", b"x" * 35, b"x" * 35 + b" y z" * 9, b"\n" * 30, b"a" * 9 + b"\n" + b"b" * 30 + b"\n c"):
        assert b"".join(p[:n] for p, n in phrases.parts(text, 3)) == text


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    same(op11_contiguous_phrases, oracle_sql()["op11_contiguous_phrases"], spark, sf)
