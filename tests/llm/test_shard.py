import collections
import random
import zlib

from betwixt.llm import shard
from betwixt.llm.queries import op1_jump_hash, oracle_sql

from ..util import same
from .util import corpus, documents, empty


def jump(key, n):
    """The published loop."""
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jumps_equal_the_published_loop(spark):
    rng = random.Random(0)
    keys = [0, 1, -1, 2**63 - 1, -(2**63)] + [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 1000, 100_000):
        got = shard.with_jump_shard(df, "k", n, "a", "b").collect()
        assert all(r.a == jump(r.k, n) and r.b == jump(r.k, n + 1) for r in got)


def test_query_equals_its_oracle(spark):
    same(op1_jump_hash, oracle_sql()["op1_jump_hash"], spark)


def test_awkward_rows(spark):
    out = shard.shard_table(documents(spark)).collect()
    rows = corpus()
    assert len(out) == len(rows)
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.shard == jump(-1 if r.doc_id is None else r.doc_id, 16) and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_only_the_new_shard_takes_rows(spark):
    df = spark.range(20_000)
    moved = shard.with_jump_shard(df, "id", 10, "a", "b").filter("a <> b").collect()
    assert all(r.b == 10 for r in moved) and 1500 < len(moved) < 2150


def test_empty(spark):
    assert shard.shard_table(empty(spark)).count() == 0


def test_columns_are_not_overwritten(spark):
    import pytest

    df = spark.createDataFrame([(1, 2, 3)], "k long, shard long, `a.b` long")
    with pytest.raises(ValueError):
        shard.with_jump_shard(df, "k", 4)
    assert shard.with_jump_shard(df, "a.b", 4, "mine").first().mine == jump(3, 4)
