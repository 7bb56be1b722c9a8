"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item Q is contained in a document X at level |Q and X| / |Q|. For a short item in a long document the
Jaccard similarity is near zero, so comparing two bounded signatures finds nothing. The asymmetric form is
used: an item's signature is its ``k`` smallest shingles under a hash, a uniform sample of Q without replacement, and
all of a document's shingles are looked up in the signatures.

Items are partitioned by size (powers of two of their shingle counts), and each partition has its own index. Its ``k``
follows from its sizes: an item of s shingles at the threshold t lacks at most s - ceil(t s) of them, so one more than
that cannot miss; where the chance of a miss falls below ``miss`` earlier, fewer do. A document probes a partition only
if it has as many shingles as the partition's smallest item must share. Every candidate is verified by exact shingle
containment over the whole text.

The items are a stated query set. They go out in blocks of bounded size (``block_shingles``), each block
against all documents; no document is shuffled or sent to the driver.

Defined results: null and empty texts and texts without a word match nothing; an item of fewer than five
words is one shingle of all its words and is looked for at that width; repeated documents and repeated items
each get rows of their own; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches
from .textnum import U, mix, shingles, slices, words

WIDTH = 5
SCHEMA = "doc_id long, item_id long, item_shingles int, shared_shingles int, containment double"
BITS = 20


def hash_count(partition: int, threshold: float, miss: float) -> int:
    """Length of the signatures of items of 2^partition to 2^(partition + 1) - 1 shingles."""
    largest = 2 ** (partition + 1) - 1
    certain = largest - _need(largest, threshold) + 1
    likely = math.ceil(math.log(miss) / math.log(max(1e-9, 1 - threshold)))
    return max(1, min(certain, likely))


def _need(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def signature(items: np.ndarray, k: int) -> np.ndarray:
    """The item's ``k`` shingles of smallest hash."""
    if len(items) <= k:
        return items
    return items[np.argpartition(mix(items ^ U(0x9E3779B97F4A7C15)), k)[:k]]


class Partition:
    """Signatures of the items of one size class and width."""

    def __init__(self, number: int, owners: list[int], sets: list[np.ndarray], threshold: float, miss: float):
        self.least = _need(2**number, threshold)  # shingles that a document must have to hold any of these
        k = hash_count(number, threshold, miss)
        signatures = [signature(sets[n], k) for n in owners]
        keys, own = np.concatenate(signatures), np.repeat(owners, [len(x) for x in signatures])
        order = np.argsort(keys, kind="stable")
        self.keys, self.own = keys[order], own[order]


class Index:
    """Size partitions and whole shingle sets of one block of items."""

    def __init__(self, rows: list[tuple[int, int, bytes]], threshold: float, miss: float):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.sets = [np.frombuffer(r[2], U) for r in rows]
        self.need = np.array([_need(len(s), threshold) for s in self.sets])
        self.widths = sorted({r[1] for r in rows})
        self.by_width = {}
        for width in self.widths:
            classes: dict[int, list[int]] = {}
            for n, r in enumerate(rows):
                if r[1] == width:
                    classes.setdefault(len(self.sets[n]).bit_length() - 1, []).append(n)
            partitions = [Partition(number, own, self.sets, threshold, miss) for number, own in sorted(classes.items())]
            seen = np.zeros(1 << BITS, bool)
            for p in partitions:
                seen[(p.keys >> U(64 - BITS)).astype(np.int64)] = True
            self.by_width[width] = (partitions, seen)

    def search(self, sh: np.ndarray, first: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of verified matches."""
        partitions, seen = self.by_width[width]
        hit = np.flatnonzero(seen[(sh >> U(64 - BITS)).astype(np.int64)])
        row = np.searchsorted(first, hit, "right") - 1
        size = first[row + 1] - first[row]
        found = []
        for p in partitions:
            fits = np.flatnonzero(size >= p.least)
            lo = np.searchsorted(p.keys, sh[hit[fits]], "left")
            n = np.searchsorted(p.keys, sh[hit[fits]], "right") - lo
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append(np.stack([np.repeat(row[fits], n), p.own[at]], 1))
        last, mine = -1, None
        for r, item in np.unique(np.concatenate(found), axis=0):
            if r != last:
                last, mine = r, np.unique(sh[first[r] : first[r + 1]])
            s = self.sets[item]
            pos = np.searchsorted(mine, s)
            shared = int((mine[np.minimum(pos, len(mine) - 1)] == s).sum())
            if shared >= self.need[item]:
                yield int(r), int(item), shared


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, width, set as packed bytes) of each item that has a word."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                w = words(b.column(1).slice(lo, hi - lo))
                sh, first = shingles(w, WIDTH)
                out = [
                    (b.column(0)[lo + i].as_py(), int(min(WIDTH, w.counts[i])), np.unique(sh[first[i] : first[i + 1]]).tobytes())
                    for i in range(hi - lo)
                    if first[i + 1] > first[i]
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in out], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.binary()))],
                    ["item_id", "width", "set"],
                )

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(sets, "item_id long, width int, set binary")


def _blocks(items: DataFrame, threshold: float, miss: float, block_shingles: int) -> Iterator:
    """Broadcast indexes of the items, each of about ``block_shingles`` shingles at most."""
    spark = items.sparkSession
    sets = item_shingles(items)
    total = sets.agg(F.coalesce(F.sum(F.octet_length("set")), F.lit(0))).first()[0] // 8
    # blocks by hash; twice as many as needed on average, so that none gets much more than block_shingles
    n_blocks = 1 if total <= block_shingles else 2 * math.ceil(total / block_shingles)
    for block in range(n_blocks):
        part = sets if n_blocks == 1 else sets.filter(F.pmod(F.xxhash64("set", "item_id"), F.lit(n_blocks)) == block)
        rows = [(-1 if r[0] is None else r[0], r[1], bytes(r[2])) for r in part.collect()]
        if rows:
            yield spark.sparkContext.broadcast(Index(sorted(rows), threshold, miss))


def _found(ix: Index, text: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, item's shingles, shared shingles)"""
    for lo, hi in slices(text):
        w = words(text.slice(lo, hi - lo))
        for width in ix.widths:
            sh, first = shingles(w, width)
            for r, item, shared in ix.search(sh, first, width):
                yield lo + r, item, len(ix.sets[item]), shared


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, miss: float = 1e-7, block_shingles: int = 2_000_000
) -> DataFrame:
    """One row for each document and item whose containment reaches ``threshold``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in _blocks(items, threshold, miss, block_shingles):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in batches:
                got = list(_found(ix, b.column(1)))
                if got:
                    r, item, size, shared = (np.array(x) for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(r)), pa.array(ix.ids[item]), pa.array(size, pa.int32()), pa.array(shared, pa.int32()), pa.array(shared / size)],
                        ["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"],
                    )

        found = texts.mapInArrow(search, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def decontaminate(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, miss: float = 1e-7, block_shingles: int = 2_000_000
) -> DataFrame:
    """The documents, with all their columns, that hold no item at ``threshold``. Nothing is joined or shuffled."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for index in _blocks(items, threshold, miss, block_shingles):

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r for r, *_ in _found(index.value, b.column(at))]] = False
                yield b.filter(pa.array(keep))

        docs = map_batches(docs, clean, docs.schema)
    return docs
