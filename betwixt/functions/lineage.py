"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="betwixt-"))
    return _OWN[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; deleted at the end."""
    path = f"{shared_dir(spark)}/betwixt-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an execution inside are deleted as it ends, since nothing reads them again; else they stay until the driver collects garbage."""
    before = spark.conf.get(_LET_GO, "false")
    spark.conf.set(_LET_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(_LET_GO, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later steps neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with shuffles_let_go(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM is gone
            return
