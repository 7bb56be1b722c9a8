"""Readers, sinks and gates that no query runs."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from betwixt.operators import datasets, harness, models
from betwixt.sources import edges as io


def test_tsv(spark, tmp_path):
    (tmp_path / "in.tsv").write_text("1\t2\tx\n3\n4\t5\n")
    io.tsv_to_edges(spark, str(tmp_path / "in.tsv"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1 2", "4 5"]


def test_results_round_trip(spark, tmp_path):
    path, schema = str(tmp_path / "r"), "method string, t long, xi double"
    rows = [("a", 25, 0.5), ("b", None, None)]
    io.write_results(spark.createDataFrame(rows, schema), path)
    assert sorted(tuple(r) for r in io.read_results(spark, path, schema).collect()) == rows


def test_long_results_are_appended(spark, tmp_path):
    path = str(tmp_path / "long")
    for t in (1, 5):
        io.append_results(spark.createDataFrame([("g", "m", t, "xi", 0.25), ("g", "m", t, "time", 2.0)], "graph string, method string, t long, metric string, value double"), path)
    got = spark.read.parquet(path)
    assert got.count() == 4 and {r.metric for r in got.collect()} == {"xi", "time"}
    assert sorted(r.t for r in got.filter("metric = 'xi'").collect()) == [1, 5]


def test_features_sink(spark, tmp_path):
    row = {"node": 3, "bc": 1.5} | {c: 0.25 for c in io.FEATURES}
    io.write_features(spark.createDataFrame(pd.DataFrame([row])), str(tmp_path / "f"))
    got = spark.read.csv(str(tmp_path / "f"), header=True).first().asDict()
    assert list(got) == ["node", "bc", *io.FEATURES] and got["bc"] == "1.5000000000"


def test_node_tables_with_edges(spark, tmp_path):
    header = ",".join(f.split()[0] for f in io.NODE_SCHEMA.split(",")) if isinstance(io.NODE_SCHEMA, str) else ",".join(io.NODE_SCHEMA.names)
    line = ",".join(["1"] * len(header.split(",")))
    for name in ("graph_1", "graph_2", "real_x"):
        (tmp_path / f"{name}.csv").write_text("\n".join([header] + [line] * 3) + "\n")
    (tmp_path / "graph_1_edges.txt").write_text("1 2\n2 1\n3 3\nx y\n2 4\n")
    (tmp_path / "real_x_edges.txt").write_text("7 8\n")
    assert {r.graph_id for r in io.read_node_tables(spark, str(tmp_path), 2).collect()} == {"graph_1", "graph_2", "real_x"}
    assert {r.graph_id for r in io.read_node_tables(spark, str(tmp_path), 2, with_edges=True).collect()} == {"graph_1", "real_x"}
    got = {tuple(r) for r in io.read_edge_files(spark, str(tmp_path)).collect()}
    assert got == {("graph_1", 1, 2), ("graph_1", 2, 1), ("graph_1", 2, 4), ("graph_1", 4, 2), ("real_x", 7, 8), ("real_x", 8, 7)}


def test_size_gates_and_trials(spark):
    c = spark.createDataFrame([(1, 10, 20), (2, 100, 50), (3, 1000, 5000)], "graph_id long, n long, m long")
    assert [r.graph_id for r in harness.gated(c, 50, 500).collect()] == [2]
    assert [r.graph_id for r in harness.gated(c, most_edges=100).collect()] == [1, 2]
    assert [harness.trials_at(1000, t) for t in (1, 25, 50, 500)] == [1000, 1000, 510, 100]


def test_combined_loss(spark):
    one = spark.createDataFrame([(1.0, 2.0, 4.0)], "a double, b double, c double")
    assert one.select(models.combined_loss(F.col("a"), F.col("b"), F.col("c"), (0.5, 0.25, 0.25)).alias("x")).first().x == pytest.approx(2.0)


def test_pairs_with_replacement(spark):
    bc = spark.createDataFrame([(i, float(i % 3)) for i in range(6)], "node long, bc double")
    out = datasets.pair_dataset(bc, 200, distinct=False).collect()
    assert len(out) == 200 and len({(r.u, r.v) for r in out}) < 100
    assert all(r.bc_u != r.bc_v and r.y == int(r.bc_u > r.bc_v) for r in out)
