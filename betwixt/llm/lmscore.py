"""Cross-entropy difference (Moore and Lewis, 2010) with matched word bigram models.

A target model (documents labelled quality 1) and a background model (all documents) have the same order, the same
smoothing and the same vocabulary: every token of any document. A token is a word (a run of letters, digits and
non-ASCII characters, in lower case) or one other character that is no white space. A document's score is the mean
over its tokens of log p_target - log p_background, that is, the difference of its cross-entropies; higher is closer
to the target.

With c counts of one model's documents, n its tokens, k its kinds of tokens and v the kinds of all documents,
p(b) = (c(b) + k / v) / (n + k) and p(b | a) = (c(ab) + PRIOR p(b)) / (c(a before any) + PRIOR).

Counts cover every document's whole text, and vocabulary and bigrams grow with the corpus, so no table is gathered
or broadcast. Documents are taken in chunks of ``CHUNK_BYTES``; a chunk sends its distinct words and bigrams, with
their counts, to buckets by ranges of their hashes, a bucket adds them up and sends each chunk the totals of what that
chunk asked for. A word or bigram is sent once by a chunk however often it occurs there, and bigrams are dealt by the
hash of both words, so neither a common word nor a common bigram makes a hot bucket. Only four numbers, tokens and
kinds of both models, reach the driver.

Texts stay where they are read, but for those that may be the target's: these are looked up by a merge join, behind a
bitmap of fixed size that lets no target document past.

Words are told apart by 64-bit hashes, the bigrams of a bucket by 40 bits beyond the bucket's range.

Defined results: a null text, or one without a word, has 0 tokens and score 0; without target documents every score
is 0; labels that disagree count as quality 1; rows with a null doc_id are never the target's; repeated rows are
counted each time and scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, key_filter, materialize, passes
from .textnum import U, WORD_BYTE, lowered, mix, raw_bytes, slices, span_hashes

PRIOR = 16.0
CHUNK_BYTES = 8 << 20  # of text in a chunk
BUCKET_BYTES = 8 << 20  # of text for each bucket
TASK_BYTES = 64 << 20  # of text for each task after a shuffle
START = U(0)  # stands before a text's first token
ROWS = "key long, chunk long, bucket int, data binary, tokens long, target_tokens long, kinds long, target_kinds long"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and how many each row has; a row without a word has none."""
    buf, offs = raw_bytes(lowered(texts))
    word = WORD_BYTE[buf]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    mark = ~word & ~SPACE[buf]
    start, end = np.flatnonzero(begins | mark), np.flatnonzero(ends | mark) + 1
    n = np.diff(np.searchsorted(start, offs))
    worded = np.diff(np.searchsorted(np.flatnonzero(begins), offs)) > 0
    keep = np.repeat(worded, n)
    h = span_hashes(buf, start[keep], end[keep])
    h[h == START] = U(1)
    return h, np.where(worded, n, 0)


def packed(*arrays: np.ndarray) -> bytes:
    """Compressed arrays; each a byte of all numbers after the other, which brings their zeros together."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays]
    raw = np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * size
    return out


def bigrams(word: np.ndarray, n: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct bigrams in the order of their hashes: hash, first word, second word, count; and each token's bigram.

    ``word`` has each token's place in ``kinds``, ``n`` the tokens of each document; START is word 0.
    """
    before = np.zeros(len(word), np.int64)
    before[1:] = word[:-1]
    first = np.cumsum(n) - n
    before[first[n > 0]] = 0
    code, which, count = np.unique(before * len(kinds) + word, return_inverse=True, return_counts=True)
    a, b = code // len(kinds), code % len(kinds)
    h = mix(kinds[a] * U(0x9E3779B97F4A7C15) + mix(kinds[b] ^ U(0xD1342543DE82EF95)))
    order = np.argsort(h)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return h[order], a[order], b[order], count[order], place[which]


def chunk_rows(chunk: int, known: np.ndarray, ids: np.ndarray, h: np.ndarray, n: np.ndarray, target: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(key, bucket, data) of a chunk: its documents (bucket -1), and what it asks of each bucket."""
    kinds, word, many = np.unique(np.concatenate([[START], h]), return_inverse=True, return_counts=True)
    word = word[1:].astype(np.int64)
    good = np.repeat(target, n)
    pair, a, b, count, which = bigrams(word, n, kinds)
    count_good = np.bincount(which[good], minlength=len(pair))
    many[0] = 0
    words = [many, np.bincount(word[good], minlength=len(kinds)), np.bincount(a, count, len(kinds)), np.bincount(a, count_good, len(kinds))]
    # words by falling frequency: their numbers are small and compress well
    often = np.argsort(-words[2], kind="stable")
    rank = np.empty(len(often), np.uint32)
    rank[often] = np.arange(len(often))
    yield chunk, -1, packed(rank[word], n.astype(np.uint32), known, ids, kinds[often])
    at, to = (np.searchsorted(bucket_of(x, buckets), np.arange(buckets + 1)) for x in (kinds, pair))
    for k in np.flatnonzero((np.diff(at) > 0) | (np.diff(to) > 0)).tolist():
        w, p = slice(at[k], at[k + 1]), slice(to[k], to[k + 1])
        yield k, k, packed(kinds[w], *[x[w].astype(np.uint32) for x in words], *inside(pair[p], buckets), count[p].astype(np.uint32), count_good[p].astype(np.uint32))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, in their order."""
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def inside(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """40 bits that tell apart the hashes of a bucket: the bits beyond those that every hash of a bucket shares."""
    x = h << U(max(0, int(math.log2(buckets)) - 1))
    return (x >> U(32)).astype(np.uint32), (x >> U(24) & U(255)).astype(np.uint8)


def summed(keys: np.ndarray, *counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each key's place among the distinct keys, and the sums of the counts."""
    distinct, which = np.unique(keys, return_inverse=True)
    return which, [np.bincount(which, np.concatenate(c), len(distinct)).astype(np.int64) for c in counts]


ASKED = [U, *[np.uint32] * 4, np.uint32, np.uint8, np.uint32, np.uint32]


def bucket_totals(asked: list[tuple[int, bytes]]) -> tuple[list[tuple[int, bytes]], list[int]]:
    """Each chunk's answer: four counts of its words and two of its bigrams; and the bucket's four totals."""
    got = [unpacked(data, *ASKED) for _, data in asked]
    words, *counts, high, low, pairs, pairs_good = (list(x) for x in zip(*got, strict=True))
    at, word_sums = summed(np.concatenate(words), *counts)
    to, pair_sums = summed(np.concatenate(high).astype(U) << U(8) | np.concatenate(low), pairs, pairs_good)
    out, w, p = [], 0, 0
    for (chunk, _), x, y in zip(asked, words, high, strict=True):
        out.append((chunk, packed(*[c[at[w : w + len(x)]] for c in word_sums], *[c[to[p : p + len(y)]] for c in pair_sums])))
        w, p = w + len(x), p + len(y)
    many, many_good = word_sums[:2]
    return out, [int(many.sum()), int(many_good.sum()), int((many > 0).sum()), int((many_good > 0).sum())]


def differences(first: np.ndarray, second: np.ndarray, counts: list[np.ndarray], totals: list[int]) -> np.ndarray:
    """log p_target - log p_background of a chunk's distinct bigrams."""
    many, many_good, after, after_good, pairs, pairs_good = (x.astype(np.float64) for x in counts)
    n, n_good, v, v_good = totals

    def log_p(c: np.ndarray, total: np.ndarray, one: np.ndarray, n: int, k: int) -> np.ndarray:
        lower = ((one + k / v) / (n + k))[second]
        return np.log((c + PRIOR * lower) / (total[first] + PRIOR))

    return log_p(pairs_good, after_good, many_good, n_good, v_good) - log_p(pairs, after, many, n, v)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """(key, rows of chunk, bucket and data) of batches that are sorted by key."""
    key, rows = None, []
    for b in batches:
        for k, chunk, bucket, data in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
            if rows and k != key:
                yield key, rows
                rows = []
            key = k
            rows.append((chunk, bucket, data.as_py()))
    if rows:
        yield key, rows


def row_batch(key: int, chunk: int, bucket: int, data: bytes | None, totals: list[int] | None = None) -> pa.RecordBatch:
    values = [key, chunk, bucket, data, *(totals or [0] * 4)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 4]
    names = [x.split()[0] for x in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)


def asked_rows(rows: DataFrame, buckets: int, skipped: Broadcast | None = None) -> DataFrame:
    """The rows of all chunks of ``rows`` (doc_id, text, target), or of (doc_id, text, hash) those that the bitmap does not pass, none of them the target's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = -1 - ((part << 32) | k)
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            for key, bucket, data in chunk_rows(chunk, *columns, buckets):
                yield row_batch(key, chunk, bucket, data)

        for b in batches:
            if skipped is not None:
                keep = ~(passes(skipped.value, b.column(2).to_numpy()) & np.asarray(b.column(0).is_valid()))
                b = b.filter(pa.array(keep))
            for lo, hi in slices(b.column(1)):
                ids, text, last = (b.column(i).slice(lo, hi - lo) for i in range(3))
                target = np.zeros(hi - lo, bool) if skipped is not None else np.asarray(last).astype(bool)
                held.append((np.array(ids.is_valid()), np.array(ids.fill_null(0)).astype(np.int64), *tokens(text), target))
                size += text.nbytes
                if size >= CHUNK_BYTES:
                    yield from flush()
                    k, size = k + 1, 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, ROWS)


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, rows in groups(batches):
        if key < 0:
            for chunk, bucket, data in rows:
                yield row_batch(chunk, chunk, bucket, data)
            continue
        rows.sort(key=lambda r: r[0])
        out, totals = bucket_totals([(chunk, data) for chunk, _, data in rows])
        for chunk, data in out:
            yield row_batch(chunk, chunk, key, data)
        yield row_batch(key, 0, key, None, totals)


def asked_by_all(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """The rows of all chunks of all documents."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("good")).distinct()
    shipped = docs.sparkSession.sparkContext.broadcast(key_filter(good, F.xxhash64("good")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("h"))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = passes(shipped.value, b.column(2).to_numpy()) & np.asarray(b.column(0).is_valid())
            if may.any():
                yield b.select([0, 1]).filter(pa.array(may))

    looked_up = (
        rows.mapInArrow(passed, "doc_id long, text string")
        .join(good.hint("merge"), F.col("doc_id") == F.col("good"), "left")
        .select("doc_id", "text", F.col("good").isNotNull().alias("target"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))  # a task that runs again makes the same chunks
    )
    return asked_rows(looked_up, buckets).unionByName(asked_rows(rows, buckets, shipped))


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train both models over all documents and score all: doc_id, n_tokens and score of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // BUCKET_BYTES
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    asked = asked_by_all(docs, labels, buckets).repartition(parts, "key").sortWithinPartitions("key")
    found = materialize(asked.mapInArrow(answered, ROWS), "totals")
    totals = [x or 0 for x in found.agg(*[F.sum(c) for c in ("tokens", "target_tokens", "kinds", "target_kinds")]).first()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches):
            rows.sort(key=lambda r: r[1])  # the documents, then the answers in the order of the hashes
            rank, n, known, ids, often = unpacked(rows[0][2], np.uint32, np.uint32, bool, np.int64, U)
            score = np.zeros(len(n))
            if totals[1] and len(rank):
                order = np.argsort(often)
                word = np.empty(len(order), np.int64)
                word[order] = np.arange(len(order))
                n = n.astype(np.int64)
                _, first, second, _, which = bigrams(word[rank], n, often[order])
                got = zip(*(unpacked(data, *[np.int64] * 6) for _, _, data in rows[1:]), strict=True)
                each = differences(first, second, [np.concatenate(x) for x in got], totals)[which]
                score = np.bincount(np.repeat(np.arange(len(n)), n), each, len(n)) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(n.astype(np.int64)), pa.array(score)], ["doc_id", "n_tokens", "score"])

    chunks = found.filter("data IS NOT NULL").repartition(parts, "key").sortWithinPartitions("key")
    return chunks.mapInArrow(run, "doc_id long, n_tokens long, score double")
