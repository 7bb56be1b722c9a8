"""The pipeline against a plain re-computation of each stage on its own input."""

import re

import numpy as np
import pyarrow as pa
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from betwixt.llm import pieces, toxicity  # noqa: E402
from betwixt.llm.common import materialize  # noqa: E402

from .test_decontam import brute as brute_leaks  # noqa: E402
from .test_secrets import PATTERNS  # noqa: E402
from .test_simjoin import brute as brute_links  # noqa: E402
from .util import documents, empty  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    tables = [docs]
    for name, stage in pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], SF), name))
    assert all(t.columns == names for t in tables[:-1])
    rows = [{r.doc_id: tuple(r) for r in t.collect()} for t in tables]
    # toxicity: kept rows are those that the model scores below a half
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score, _ = toxicity.scored(model, pa.array([r[1] for r in rows[0].values()]))
    assert set(rows[1]) == {d for d, s in zip(rows[0], score, strict=True) if s < 0.5}
    # similarity join: the smallest id of each class
    _, classes = brute_links(list(rows[1].values()))
    assert set(rows[2]) == set(classes)
    # decontamination
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {d for d, _, _ in brute_leaks([(d, r[1]) for d, r in rows[2].items()], items)}
    assert set(rows[3]) == set(rows[2]) - leaks and leaks
    # secrets: no base match is left, other texts are as they were
    assert set(rows[4]) == set(rows[3])
    for d, r in rows[4].items():
        before = rows[3][d][1]
        if r[1] == before:
            continue
        assert "[SECRET]" in r[1] and r[4] == len(r[1])
        plain = re.split(re.escape("[SECRET]"), r[1])
        assert before.startswith(plain[0]) and before.endswith(plain[-1])
    for text in (r[1] for r in rows[4].values()):
        for k, (_, p) in enumerate(PATTERNS):
            assert not any((len(m.group(2)) >= 12 if k == 0 else m.end() - m.start() >= (18, 16)[k - 1]) for m in p.finditer(text))
    # pieces
    v = pieces.load_vocabulary()
    for r in tables[5].collect():
        assert pieces.decode_texts(np.array(r.ids), np.array([0, len(r.ids)]), v) == [rows[4][r.doc_id][1]]
    got = {r.doc_id: r.ids for r in pipeline.run(spark, SF).collect()}
    assert got == {r.doc_id: r.ids for r in tables[5].collect()}


def test_awkward_rows_pass_every_stage(spark):
    docs = documents(spark)
    for name, stage in pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        docs = out
    assert pipeline.STAGES[-1][1](spark, docs, SF).filter("NOT lossless").count() == 0
    docs = empty(spark)
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
    assert docs.count() == 0
