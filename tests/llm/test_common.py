import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from betwixt.llm import common, graphs


def held_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read()).group(1)) / 1024


class Frame:
    columns = ["a"]

    def toDF(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_task_gives_its_memory_back():
    """A worker is used again: small pieces below one that is still held would stay with it."""
    pins = []

    def run(batches):
        pieces = [np.ones(75) for _ in range(200_000)]  # 120 MB, none of them large enough for a mapping of its own
        pins.append(np.ones(75))
        yield pa.RecordBatch.from_pydict({"n": [len(pieces)]})

    before = held_mb()
    out = list(common.map_batches(Frame(), run, "n long")(iter([])))
    assert out[0].column(0)[0].as_py() == 200_000
    assert held_mb() - before < 60


def test_small_tables_are_few_files(spark):
    cores = spark.sparkContext.defaultParallelism
    table = spark.range(1000).repartition(60)
    assert common.packed(table, 1000, 8).rdd.getNumPartitions() == cores
    assert common.packed(table, 20 << 20, 16).rdd.getNumPartitions() == 40  # 320 MB
    assert common.packed(table, 1 << 30, 16).rdd.getNumPartitions() == 60
    assert common.packed(table, 1000, 8).agg(F.sum("id")).first()[0] == 499_500


def test_rounds_of_components_are_few_files(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = graphs.components(spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
        assert {r.root for r in out.collect()} == {0} and out.count() == 400
        assert len(out.inputFiles()) <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
