import itertools
import re

import numpy as np
import pytest

from betwixt.llm import decontam
from betwixt.llm.queries import op5_minhash_containment
from betwixt.llm.textnum import mix

from .util import corpus, documents, empty, prose

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def shingles(text, width=5):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, items, threshold=0.8):
    out = []
    for d, text in docs:
        for i, item in items:
            q = shingles(item or "")
            if q:
                width = min(5, len(WORD.findall(item.lower())))
                shared = len(q & shingles(text or "", width))
                if shared >= threshold * len(q) - 1e-9:
                    out.append((d, i, shared))
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "'x' AS doc_id")


def test_same_as_brute_force(spark):
    rows = corpus()
    long = next(r[1] for r in rows if r[0] == 42)
    w = long.split()
    items = [(1, " ".join(w[15_000:15_030])), (2, " ".join(w[100:110]) + " other words here now"), (3, "one two"), (4, None), (5, ""), (6, prose(30, 77)), (7, rows[3][1][:300]), (7, rows[3][1][:300]), (8, "?!")]
    docs = documents(spark, rows)
    got = sorted(((r.doc_id, r.item_id, r.shared_shingles) for r in decontam.contained_items(docs, items_of(spark, items)).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in rows], items)
    assert (42, 1, 26) in got
    blocks = sorted(((r.doc_id, r.item_id, r.shared_shingles) for r in decontam.contained_items(docs, items_of(spark, items), block_shingles=40).collect()), key=str)
    assert blocks == got


def test_query_on_the_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(((r.doc_id, r.item_id, r.shared_shingles) for r in op5_minhash_containment(spark, d).collect()), key=str)
    assert got == brute(docs, items)


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    rows = corpus()
    docs = documents(spark, rows)
    items = items_of(spark, [(1, rows[2][1])])
    out = decontam.decontaminate(docs, items)
    assert out.columns == docs.columns
    bad = {d for d, _, _ in brute([(r[0], r[1]) for r in rows], [(1, rows[2][1])])}
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in bad), key=str)


def test_empty(spark):
    items = items_of(spark, [(1, "a b c d e f")])
    assert decontam.contained_items(empty(spark), items).count() == 0
    assert decontam.contained_items(documents(spark), items.limit(0)).count() == 0
    assert decontam.decontaminate(documents(spark), items.limit(0)).count() == len(corpus())


@pytest.mark.parametrize("n", [3, 15, 400])
def test_signature_is_part_of_the_item(n):
    x = mix(np.arange(n).astype(np.uint64))
    s = decontam.signature(x, 11)
    assert set(s) <= set(x) and len(set(s)) == min(n, 11)


def test_partitions_decide_hashes_and_probes():
    assert [decontam.hash_count(p, 0.8, 1e-7) for p in range(7)] == [1, 1, 2, 4, 7, 11, 11]
    sets = [np.sort(mix(np.arange(n).astype(np.uint64) + np.uint64(1000 * n))) for n in (6, 10, 100)]
    ix = decontam.Index([(i, 5, s.tobytes()) for i, s in enumerate(sets)], 0.8, 1e-7)
    parts, _ = ix.by_width[5]
    assert [p.least for p in parts] == [4, 7, 52] and [len(p.keys) for p in parts] == [2, 4, 11]
    # an item that lacks as many shingles as it may is found whichever they are
    for lost in itertools.combinations(range(10), 2):
        doc = np.delete(sets[1], lost)
        assert list(ix.search(doc, np.array([0, len(doc)]), 5)) == [(0, 1, 8)]


def test_columns_of_any_name(spark):
    docs = documents(spark).selectExpr("*", "1 AS `a.b`", "2 AS item_id")
    out = decontam.decontaminate(docs, items_of(spark, [(1, corpus()[2][1])]))
    assert out.columns == docs.columns and 0 < out.count() < len(corpus())
