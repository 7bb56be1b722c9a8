"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A stable key and the shard count decide the shard; no ring table exists. With one more shard the
only rows that move are those that the new shard takes (about 1/(n+1) of all).

The 64-bit generator ``key = key * 2862933555777941757 + 1 (mod 2^64)`` is evaluated in 16- and
32-bit limbs, so it neither overflows under ANSI mode nor depends on that setting.

Defined results: a null key hashes as -1; a null text has 0 bytes (size 1, CRC 0); rows that repeat
a key go to that key's shard and get slots of their own; an empty table gives an empty result; other
columns of the input are ignored by ``shard_table`` and kept by ``with_jump_shard``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import duckdb_crc32, fresh, named

M32 = 0xFFFFFFFF
#: Jumps made at most per key. The count is near ln(shards); beyond 128 the row raises an error.
MOST_JUMPS = 128


def _next_state(key: Column) -> Column:
    """key * 2862933555777941757 + 1 modulo 2^64. The multiplier's 16-bit limbs: 27BB 2EE6 87B0 B0FD."""
    low, high = key.bitwiseAND(F.lit(M32)), F.shiftrightunsigned(key, 32)
    p1 = low * F.lit(0x87B0)
    t = low * F.lit(0xB0FD) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    up = (
        F.shiftright(t, 32)
        + F.shiftright(p1, 16)
        + high * F.lit(0xB0FD)
        + F.shiftleft((high * F.lit(0x87B0)).bitwiseAND(F.lit(0xFFFF)), 16)
        + low * F.lit(0x2EE6)
        + F.shiftleft((low * F.lit(0x27BB)).bitwiseAND(F.lit(0xFFFF)), 16)
    )
    return F.shiftleft(up.bitwiseAND(F.lit(M32)), 32).bitwiseOR(t.bitwiseAND(F.lit(M32)))


def jump_shards(key: Column, n_shards: int) -> Column:
    """Struct (shard, grown): the key's shard among ``n_shards`` and among ``n_shards + 1``.

    Both come from one sequence of jumps: the last jump below n is the shard among n.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    more = n_shards + 1
    zero = F.struct(
        F.coalesce(key.cast("long"), F.lit(-1).cast("long")).alias("key"),
        F.lit(0).cast("long").alias("j"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"),
    )

    def step(s: Column, _: Column) -> Column:
        key2 = _next_state(s["key"])
        r = (F.shiftrightunsigned(key2, 33) + F.lit(1)).cast("double")
        j2 = F.floor((s["j"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / r)).cast("long")
        return F.when(
            s["j"] < F.lit(more),
            F.struct(
                key2.alias("key"),
                j2.alias("j"),
                F.when(s["j"] < F.lit(n_shards), s["j"]).otherwise(s["shard"]).alias("shard"),
                s["j"].alias("grown"),
            ),
        ).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(min(more, MOST_JUMPS)))
    end = F.aggregate(steps, zero, step)
    out = F.struct(end["shard"].cast("int").alias("shard"), end["grown"].cast("int").alias("grown"))
    if more <= MOST_JUMPS:
        return out
    return F.when(end["j"] >= F.lit(more), out).otherwise(F.raise_error(F.lit("more jumps than MOST_JUMPS")))


def with_jump_shard(df: DataFrame, key: str, n_shards: int, shard: str = "shard", grown: str | None = None) -> DataFrame:
    """``df`` with its shard (and, if named, the shard after one more is appended); columns of these names are refused."""
    taken = {c.lower() for c in df.columns} & {c.lower() for c in (shard, grown) if c}
    if taken:
        raise ValueError(f"the table has columns {sorted(taken)}")
    (jump,) = fresh(df.columns, "jump")
    both = df.withColumn(jump, jump_shards(named(key), n_shards))
    both = both.withColumn(shard, F.col(jump)["shard"])
    if grown:
        both = both.withColumn(grown, F.col(jump)["grown"])
    return both.drop(jump)


def with_slots(df: DataFrame, shard: str, spread: str, order: list[str], buckets: int, slot: str = "slot") -> DataFrame:
    """A gapless number from 0 in each shard.

    A shard may hold any share of the rows, so no task ever numbers a whole shard: rows are numbered
    in ``buckets`` hashed parts of each shard, and the parts' counts give the offsets. ``spread`` is the
    string column that is hashed.
    """
    part = F.conv(F.substring(F.md5(F.col(spread)), 1, 4), 16, 10).cast("int") % F.lit(buckets)
    rows = df.withColumn("__part", part)
    sizes = rows.groupBy(shard, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(shard).alias("__s"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    within = Window.partitionBy(shard, "__part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = rows.withColumn("__in", F.row_number().over(within) - F.lit(1))
    return (
        numbered.join(offsets, (F.col(shard) == F.col("__s")) & (F.col("__part") == F.col("__p")))
        .withColumn(slot, (F.col("__before") + F.col("__in")).cast("long"))
        .drop("__part", "__in", "__s", "__p", "__before")
    )


def shard_table(docs: DataFrame, n_shards: int = 16, buckets: int = 1024) -> DataFrame:
    """One row per document: its size, CRC, shard, slot, and shard if one more is appended."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = with_jump_shard(base, "doc_id", n_shards, "shard", "grown_shard")
    placed = placed.withColumn("__spread", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string")))
    out = with_slots(placed, "shard", "__spread", ["doc_id", "text_crc32", "size"], buckets)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def oracle(n_shards: int = 16, buckets: int = 1024) -> str:
    """The same in DuckDB SQL: 128-bit integers carry the generator, a recursive CTE the jumps."""
    return f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
jump(doc_id, key, j, shard, grown) AS (
  SELECT DISTINCT doc_id, doc_id::HUGEINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM base
  UNION ALL
  SELECT doc_id, k2,
    floor((j + 1)::DOUBLE * (2147483648::DOUBLE / (k2 // 8589934592::HUGEINT + 1)::DOUBLE))::BIGINT,
    CASE WHEN j < {n_shards} THEN j ELSE shard END, j
  FROM (SELECT *, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM jump WHERE j <= {n_shards})),
ended AS (SELECT doc_id, shard, grown FROM jump WHERE j > {n_shards}),
crc AS (SELECT doc_id, size, {duckdb_crc32('t')} AS text_crc32 FROM base),
placed AS (
  SELECT c.doc_id, c.size, c.text_crc32, e.shard, e.grown,
    ('0x' || substr(md5(c.doc_id::VARCHAR || ':' || c.text_crc32::VARCHAR), 1, 4))::INTEGER % {buckets} AS part
  FROM crc c JOIN ended e ON c.doc_id = e.doc_id)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
FROM placed"""
