import numpy as np
import pyarrow as pa
import pytest

from betwixt.llm import quality
from betwixt.llm.lmscore import tokens
from betwixt.llm.queries import op12_random_indexing_quality

from .util import corpus, documents, empty

SF = "/root/testdata/sf0.01"


def plain_sums(texts):
    """A token, a neighbour and an entry at a time."""
    out = np.zeros((1 << quality.BITS, quality.DIM + 1), np.int64)
    for t in texts:
        h, _ = tokens(pa.array([t]))
        place, sign = quality.index_entries(h)
        at = quality.slot(h).tolist()
        for i, s in enumerate(at):
            out[s, quality.DIM] += 1
            for j in range(max(0, i - quality.REACH), min(len(at), i + quality.REACH + 1)):
                if i != j:
                    for p, x in zip(place[:, j], sign[:, j]):
                        out[s, p] += x
    return out


def test_contexts_by_brute_force(spark, monkeypatch):
    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 5000]
    got = quality.context_sums(documents(spark, rows))
    assert np.array_equal(got, plain_sums([r[1] for r in rows if r[1]]))
    assert not quality.context_sums(empty(spark)).any()


def test_index_vectors_are_balanced():
    place, sign = quality.index_entries(np.arange(1, 20_001).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert set(np.unique(sign)) == {-1, 1} and abs(sign.mean()) < 0.02
    assert np.bincount(place.reshape(-1), minlength=quality.DIM).min() > 0.8 * place.size / quality.DIM


def test_pooling_by_brute_force(monkeypatch):
    """Also where long texts are taken in parts, which end a word at white space only."""
    texts = [r[1] for r in corpus() if r[1] is None or len(r[1]) < 5000] + ["word " * 700, "", None, "one two"]
    pooling = quality.Pooling.of(plain_sums([t for t in texts if t]))
    want = []
    for t in texts:
        h, _ = tokens(pa.array([t or ""]))
        mean = pooling.vectors[quality.slot(h)].mean(0) if len(h) else np.zeros(quality.DIM)
        want.append([*mean, np.log1p(len(h))])
    assert np.allclose(pooling.features(pa.array(texts)), want, atol=1e-6)
    monkeypatch.setattr(quality, "PART", 400)
    assert np.allclose(pooling.features(pa.array(texts)), want, atol=1e-6)


def test_parts_join_to_the_text(monkeypatch):
    monkeypatch.setattr(quality, "PART", 11)
    texts = ["", None, "é" * 40, "one two three four five six", "x" * 50, " \n" * 9]
    cut, row = quality.text_parts(pa.array(texts))
    for i, t in enumerate(texts):
        assert "".join(cut.to_pylist()[k] for k in np.flatnonzero(row == i)) == (t or "")


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 5)), (rng.random(20) < 0.4).astype(float)
    weights = [rng.normal(size=s) for s in ((5, 3), (3,), (3,), (1,))]

    def loss(w):
        return quality.cross_entropy(quality.Network(np.zeros(5), np.ones(5), w).logits(x), y)

    for i, g in enumerate(quality.gradient(weights, x, y)):
        for at in np.ndindex(g.shape):
            moved = [[w.copy() for w in weights] for _ in range(2)]
            moved[0][i][at] += 1e-6
            moved[1][i][at] -= 1e-6
            assert g[at] == pytest.approx((loss(moved[0]) - loss(moved[1])) / 2e-6, abs=1e-6)


def test_temperature_is_the_best(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = (rng.random(600) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    held = np.arange(600) % 5 == 0
    m = quality.fitted(x, y, held)
    logits = m.logits(x[held])
    own = quality.cross_entropy(logits / m.temperature, y[held])
    assert all(own <= quality.cross_entropy(logits / t, y[held]) + 1e-3 for t in (0.3, 0.5, 0.8, 1, 1.3, 2, 4))
    again = quality.fitted(x, y, held)
    assert all(np.array_equal(a, b) for a, b in zip(m.weights, again.weights))


def test_awkward_rows(spark):
    rows = corpus()
    labels = spark.createDataFrame([(i % 60, i % 2, 0) for i in range(90)] + [(None, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_table(documents(spark, rows), labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    same = [r.score for r in got if r.doc_id in (30, 31, 32, 33)]
    assert len(set(same)) == 1 and len({r.score for r in got if r.doc_id == 5}) == 1
    assert quality.quality_table(empty(spark), labels).count() == 0
    one = labels.filter("quality = 1")
    assert {round(r.score, 3) for r in quality.quality_table(documents(spark, rows), one).collect()} == {1.0}
    assert {r.score for r in quality.quality_table(documents(spark, rows), labels.limit(0)).collect()} == {0.5}


def test_held_out_quality(spark):
    out = op12_random_indexing_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    out = out[out.held_out]
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95 and (good >= 0.3).mean() > 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from betwixt.llm.common import crc_of_id
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(crc_of_id("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    assert sorted(map(tuple, quality.quality_table(docs, labels).collect())) == sorted(map(tuple, quality.quality_table(docs, turned).collect()))
