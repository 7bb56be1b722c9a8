import base64
import collections
import math
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from betwixt.llm import pieces
from betwixt.llm.queries import op4_ffbs_pieces

from .util import corpus, documents, empty

VOCABULARY = pieces.load_vocabulary()
ENCODER = pieces.Encoder(VOCABULARY, 0.5)


def segmentations(word):
    """All paths of a word's lattice with their weights, by recursion."""
    v = VOCABULARY

    def go(i):
        if i == len(word):
            return [((), 1.0)]
        out = []
        for j in range(i + 1, len(word) + 1):
            p = v.lookup.get(word[i:j])
            if p is not None:
                out += [((int(v.ids[p]), *rest), x * ENCODER.weight[p]) for rest, x in go(j)]
        return out

    return go(0)


@pytest.mark.parametrize("text", ["hello", "ab", "the"])
def test_samples_follow_the_lattice(text):
    paths = segmentations((" " + text).encode())
    total = sum(x for _, x in paths)
    n = 20_000
    ids, offs, _, _ = ENCODER.encode(pa.array([text] * n), np.arange(n).astype(np.uint64))
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(offs[:-1], offs[1:], strict=True))
    assert set(seen) <= {p for p, _ in paths}
    assert all(seen[p] / n == pytest.approx(x / total, abs=0.015) for p, x in paths)


def plain(text, key, alpha):
    """One pass over the whole lattice of a text in logarithms, and one draw for each step."""
    v, raw = VOCABULARY, (b" " + text.encode()) if text else b""
    n, ends = len(raw), pieces.char_ends(np.frombuffer(raw, np.uint8)).tolist()
    into, total, inner = [[] for _ in range(n + 1)], [0.0] + [-math.inf] * n, set()
    for i in range(n):
        for j in range(i + 1, min(n, i + v.longest) + 1):
            p = v.lookup.get(raw[i:j])
            if p is not None:
                into[j].append((i, p, alpha * v.logs[p]))
        if i not in inner:
            inner.update(range(i + 1, ends[i]))
            if raw[i : ends[i]] not in v.lookup:
                into[ends[i]].append((i, -1, alpha * v.byte_log * (ends[i] - i)))
        if into[i + 1]:
            x = [total[a] + w for a, _, w in into[i + 1]]
            if max(x) > -math.inf:
                total[i + 1] = max(x) + math.log(sum(math.exp(y - max(x)) for y in x))
    out, at, seed = [], n, pieces.row_seeds(np.array([key], np.uint64))
    while at:
        u = float(pieces.uniform(seed, np.array([at]))[0])
        options = sorted(into[at], key=lambda o: -o[0])
        for a, p, w in options:
            u -= math.exp(total[a] + w - total[at])
            if u < 0:
                break
        out += [int(v.ids[p])] if p >= 0 else [int(v.byte_ids[x]) for x in reversed(raw[a:at])]
        at = a
    return out[::-1]


PLAIN = ["hello world", "a" * 90 + " tail", "\U0001f9ff" * 15, "completely ordinary sentences", "Zx8/Qm2kL0pR7vT1nYw3+bGdHsJe5uXa9" * 6, "日本語と中文字" * 30, "tab\tand\nnew  lines   here", "x" * 64, "x" * 65, "é\u0000▁"]


@pytest.mark.parametrize("alpha", [0.1, 0.5, 1.0, 2.0, 9.0])
def test_encoding_by_brute_force(alpha, monkeypatch):
    """Also where parts and units are cut elsewhere, and beside text in bytes."""
    encoder = pieces.Encoder(VOCABULARY, alpha)
    keys = (np.arange(len(PLAIN)) * 12345).astype(np.uint64)
    want = [plain(t, int(k), alpha) for t, k in zip(PLAIN, keys)]
    for long, chunk, run, block in ((64, 1 << 20, 1 << 20, 2048), (3, 1 << 20, 1 << 20, 2048), (10**9, 1 << 20, 1 << 20, 2048), (64, 20, 1 << 20, 2048), (64, 20, 5, 7), (64, 1 << 20, 12, 2048), (64, 90, 30, 64)):
        monkeypatch.setattr(pieces, "LONG", long)
        monkeypatch.setattr(pieces, "CHUNK", chunk)
        monkeypatch.setattr(pieces, "RUN", run)
        monkeypatch.setattr(pieces, "BLOCK", block)
        ids, offs, _, _ = encoder.encode(pa.array(PLAIN), keys)
        assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == want
        assert [encoder.encode(pa.array([t]), keys[i : i + 1])[0].tolist() for i, t in enumerate(PLAIN)] == want


def test_runs_that_pieces_cross_everywhere():
    """A MB of one letter: what is kept follows the run by a few bytes a byte, and each second takes a good part of a MB."""
    texts = ["a" * 1_000_000, "ab" * 20_000 + " plain words " + "é" * 30_000]
    began = time.time()
    ids, offs, _, _ = ENCODER.encode(pa.array(texts[:1]), np.array([7], np.uint64))
    assert pieces.decode_texts(ids, offs, VOCABULARY) == texts[:1] and time.time() - began < 40
    tracemalloc.start()
    ENCODER.encode(pa.array(["a" * 140_000]), np.array([7], np.uint64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    both, offs, _, _ = ENCODER.encode(pa.array([*texts, "short"]), np.array([7, 8, 9], np.uint64))
    assert pieces.decode_texts(both, offs, VOCABULARY) == [*texts, "short"] and np.array_equal(both[: offs[1]], ids)


def test_long_text_without_spaces():
    text = base64.b64encode(np.random.default_rng(0).bytes(3_000_000)).decode()
    tracemalloc.start()
    ids, offs, _, _ = ENCODER.encode(pa.array([text]), np.array([7], np.uint64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pieces.decode_texts(ids, offs, VOCABULARY) == [text]
    assert peak < 120e6  # of the text and its ids; a part costs little


def test_decoding_is_lossless():
    texts = ["", " ", "a", "hello world", " a  b\nc▁d é\t", "日本語 \U0001f600x", "x" * 500 + " y\r\n\r\n", None, "\n", "\u0000", "▁▁ ▁", "word" * 200, "é" * 100, ";\r\n}\r"]
    ids, offs, _, _ = ENCODER.encode(pa.array(texts), np.arange(len(texts)).astype(np.uint64))
    assert pieces.decode_texts(ids, offs, VOCABULARY) == [t or "" for t in texts]


def test_result_depends_on_the_row_only(spark):
    texts = [t for _, t, *_ in corpus() if t]
    keys = np.arange(len(texts)).astype(np.uint64)
    ids, offs, _, _ = ENCODER.encode(pa.array(texts), keys)
    for i in (0, 3, len(texts) - 1):
        alone, _, _, _ = ENCODER.encode(pa.array([texts[i]]), keys[i : i + 1])
        assert np.array_equal(alone, ids[offs[i] : offs[i + 1]])
    other, _, _, _ = ENCODER.encode(pa.array([texts[0]]), np.array([999], np.uint64))
    assert not np.array_equal(other, ids[: offs[1]])


def test_awkward_rows_and_decoding_operator(spark):
    rows = corpus()
    out = pieces.sample_encode(documents(spark, rows), ["doc_id", "key", "score"])
    got = out.collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert all((r.ids is None, r.n_pieces) == (True, 0) for r in got if r.doc_id == 30)
    assert all(len(r.ids) == r.n_pieces for r in got if r.ids is not None)
    back = collections.Counter((r.doc_id, r.text) for r in pieces.decode(out, ["doc_id"]).collect())
    assert back == collections.Counter((r[0], r[1]) for r in rows)
    twice = [r.ids for r in got if r.doc_id == 5]
    assert twice[0] == twice[1]
    assert pieces.sample_encode(empty(spark), ["doc_id"]).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    out = op4_ffbs_pieces(spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: r.n_bytes for r in out} == {i: len(t.encode()) for i, t in texts.items()} and all(r.lossless for r in out)
    for r in out:
        if len(texts[r.doc_id]) < 4000:
            assert list(r.ids) == plain(texts[r.doc_id], r.doc_id, 0.5), r.doc_id


def test_memory_of_a_chunk():
    """Two workers of an executor hold a chunk each: its working arrays stay below 30 MB."""
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"etaoinshrdlucmfwypvbgk", np.uint8)
    words = [bytes(rng.choice(letters, n)).decode() for n in rng.integers(2, 10, 30_000)]
    texts = pa.array([" ".join(words[i] for i in rng.integers(0, len(words), 500)) for _ in range(500)])
    ENCODER.encode(texts.slice(0, 1), np.zeros(1, np.uint64))  # tables that all chunks share
    tracemalloc.start()
    for lo, hi in pieces.slices(texts, pieces.CHUNK):
        ENCODER.encode(texts.slice(lo, hi - lo), np.arange(lo, hi).astype(np.uint64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20, peak >> 20
