"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lineage import written

FILTER_BITS = 26  # 8 MB, whatever it holds
PART_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the folder that all executors share and read it back, which cuts the lineage."""
    return written(df, name)


def packed(df: DataFrame, rows: int, row_bytes: int, costly: bool = False) -> DataFrame:
    """``df`` in no more partitions than about ``rows`` rows of ``row_bytes`` bytes are worth, but one for each core.

    Where a session deals everything to hundreds of partitions, a small table would be as many files, and on a local file
    system each file costs the JVM two processes that set its permissions. What is ``costly`` to compute keeps its tasks;
    its rows are dealt anew.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows * row_bytes / PART_BYTES))
    return df.repartition(parts) if costly else df.coalesce(parts)


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(taken: list[str], *stems: str) -> list[str]:
    """Names for helper columns that no column of the input has."""
    low = {c.lower() for c in taken}
    tail = ""
    while any((s + tail).lower() in low for s in stems):
        tail += "_"
    return [s + tail for s in stems]


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` of columns of any name: the function sees them numbered, in their order."""

    def returning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(returning, schema)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks and would hold it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def key_filter(keys: DataFrame, hashed: Column) -> np.ndarray:
    """A bitmap of 2 ** FILTER_BITS bits in which the bit of each row's 64-bit hash is set.

    Of a fixed size, so that it may be broadcast; the more keys, the more other rows pass it. Rows that pass are looked
    up exactly, so results do not depend on it.
    """
    at = F.shiftrightunsigned(hashed, 64 - FILTER_BITS)
    word = F.shiftrightunsigned(at, 6).cast("int").alias("word")
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    rows = keys.select(at.alias("at"), word).select("word", bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def passes(bitmap: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which hashes may be among the keys of ``key_filter``."""
    at = hashed.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Keep Arrow batches at ``size`` (or one row), so that Python workers hold a few MB of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def crc_of_id(col: Column | str) -> Column:
    """crc32 of an id written as text."""
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string").cast("binary"))


def crc_table() -> list[int]:
    """The 16 nibble entries of the reflected CRC-32 (polynomial 0xEDB88320)."""
    out = []
    for i in range(16):
        c = i
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def duckdb_crc32(text_sql: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of a string's UTF-8 bytes."""
    t = "[" + ",".join(f"{x}::BIGINT" for x in crc_table()) + "]"
    step = (
        "lambda c, b: xor((xor(c, b) >> 4), {t}[(xor(c, b) & 15) + 1])".replace("{t}", t)
    )
    # each byte goes in as its low nibble and then its high nibble
    nibbles = (
        f"list_transform(regexp_extract_all(regexp_replace(hex(encode({text_sql})), '(.)(.)', '\\2\\1', 'g'), '.'), "
        "lambda x: (instr('0123456789ABCDEF', x) - 1)::BIGINT)"
    )
    return f"xor(list_reduce({nibbles}, {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
