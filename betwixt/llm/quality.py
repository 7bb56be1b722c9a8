"""Quality of documents by random-indexing word vectors, pooled, and a two-layer network with calibrated probabilities.

Random indexing (Kanerva, Kristofersson and Holst, 2000): each token has an index vector of ``SPARSE`` entries of +1 or -1
among ``DIM`` zeros, which follows from its hash; a word's vector is the sum of the index vectors of the tokens up to
``REACH`` places from it, over all its occurrences in all documents. Words share ``1 << BITS`` slots by their hashes,
so the table of vectors has the same size whatever the corpus (8 MB), and no word of any text is unknown. A token is a
word (a run of letters, digits and non-ASCII characters, in lower case) or one other character that is no white space.

A document is pooled as the mean of its tokens' vectors, each less the mean vector of all tokens, of length one, and weighted
by a / (a + share of all tokens); with the logarithm of its length. The network, tanh units and one logistic
unit, is fitted by Adam on the whole of a bounded sample of labelled documents: at most ``SAMPLE`` of each class, in
order of a hash of doc_id. A fifth of them is held back to choose when to stop and the temperature that divides the
logits: those of least cross-entropy. Vectors and counts are of all documents, and all documents are scored over their whole texts.

Sums of vectors are integers: tasks add up what they read, blocks of slots meet in two steps, so that no task adds up
what all tasks send, and one table of fixed size reaches the driver. Texts of more than ``PART`` bytes are taken in parts, cut at white space;
contexts end there.

Defined results: null, empty and blank texts are pooled as a zero vector and scored like any other; without labelled
rows of both classes every score is the share of label 1 (0.5 if none); labels that disagree on a document count as 1,
other values than 0 and 1 and null ids are ignored; of rows that repeat a labelled id one, chosen by its text's hash, is
learned from; repeated rows are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_of_id, map_batches
from .lmscore import tokens
from .textnum import U, mix, slices

BITS, DIM, SPARSE, REACH = 15, 63, 4, 2  # a slot has DIM sums and its tokens
BLOCK = 1 << 10  # slots of a row of sums
SPREAD = 16  # rows of a block of slots that meet first
PART = 1 << 18
RARE = 1e-3
SAMPLE = {0: 8000, 1: 8000}
HIDDEN, EPOCHS, RATE, DECAY = 32, 300, 0.01, 1e-4
THRESHOLD = 0.3
BLANKS = b" \n\t\r"


def text_parts(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Rows in parts of at most about ``PART`` bytes, and the row of each."""
    if not len(text) or text.nbytes <= PART:
        return text, np.arange(len(text))
    out, rows = [], []
    for i, x in enumerate(text.cast(pa.large_binary())):
        data, at = x.as_py() or b"", 0
        while True:
            to = at + PART
            if to < len(data):
                cut = max(data.rfind(bytes([c]), at + 1, to) for c in BLANKS)
                to = cut if cut > 0 else to
                while 0 < to < len(data) and data[to] & 0xC0 == 0x80:  # inside a character
                    to += 1
            out.append(data[at:to])
            rows.append(i)
            at = to
            if at >= len(data):
                break
    return pa.array(out, pa.large_binary()).cast(pa.large_string(), safe=False), np.array(rows)


def index_entries(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(SPARSE, tokens) places and signs of the tokens' index vectors; places may repeat."""
    at = np.stack([mix(h + U(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k in range(SPARSE)])
    return ((at >> U(32)) % U(DIM)).astype(np.int64), np.where(at & U(1), np.int8(1), np.int8(-1))


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.int64)


def add_contexts(sums: np.ndarray, h: np.ndarray, n: np.ndarray) -> None:
    """Add the contexts of tokens ``h``, of texts of ``n`` tokens, to the sums of their slots."""
    if not len(h):
        return
    own, text = slot(h) * (DIM + 1), np.repeat(np.arange(len(n)), n)
    place, sign = index_entries(h)
    at, more = [own + DIM], [np.ones(len(h), np.int8)]
    for step in range(1, REACH + 1):
        left = np.flatnonzero(text[step:] == text[:-step])
        for a, b in ((left, left + step), (left + step, left)):
            at += list(own[a] + place[:, b])
            more += list(sign[:, b])
    flat = sums.reshape(-1)
    flat += np.bincount(np.concatenate(at), np.concatenate(more), len(flat)).astype(sums.dtype)


def add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each block of (block, spread, sums) over the rows that meet in a task."""
    held: dict[int, np.ndarray] = {}
    spread = 0
    for b in batches:
        for block, to, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            spread, got = to, unpacked(data)
            held[block] = held[block] + got if block in held else got
    for block, x in held.items():
        yield block_row(block, spread, x)


def unpacked(data: pa.Scalar) -> np.ndarray:
    raw = pa.decompress(data.as_buffer(), decompressed_size=BLOCK * (DIM + 1) * 8, codec="zstd")
    return np.frombuffer(raw, np.int64)


def block_row(block: int, spread: int, x: np.ndarray) -> pa.RecordBatch:
    data = pa.compress(x.astype(np.int64).tobytes(), codec="zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([spread], pa.int32()), pa.array([data], pa.binary())], ["block", "spread", "sums"])


def context_sums(docs: DataFrame) -> np.ndarray:
    """(slots, DIM + 1): the context of each slot's tokens over all documents, and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((1 << BITS, DIM + 1), np.int32)
        part, many = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi in slices(b.column(0), PART):
                h, n = tokens(text_parts(b.column(0).slice(lo, hi - lo))[0])
                add_contexts(sums, h, n)
                many += len(h)
                if many > 1 << 28:  # what 32 bits hold
                    yield from given(sums, part)
                    sums[:], many = 0, 0
        yield from given(sums, part)

    def given(sums: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
        for block in range(0, (1 << BITS) // BLOCK):
            x = sums[block * BLOCK : (block + 1) * BLOCK]
            if x.any():
                yield block_row(block, part % SPREAD, x.reshape(-1))

    schema = "block int, spread int, sums binary"
    rows = map_batches(docs.select("text"), run, schema).repartition("block", "spread")
    rows = map_batches(map_batches(rows, add_blocks, schema).repartition("block"), add_blocks, schema)
    out = np.zeros((1 << BITS, DIM + 1), np.int64)
    for block, _, data in rows.collect():  # 1 << BITS slots
        out[block * BLOCK : (block + 1) * BLOCK] += unpacked(pa.scalar(bytes(data))).reshape(BLOCK, -1)
    return out


@dataclass
class Pooling:
    vectors: np.ndarray  # (slots, DIM), weighted

    @staticmethod
    def of(sums: np.ndarray) -> Pooling:
        context, n = sums[:, :DIM].astype(np.float64), sums[:, DIM].astype(np.float64)
        total = max(1.0, n.sum())
        mean = context / np.maximum(n, 1)[:, None]
        mean -= (context.sum(0) / total)[None]
        mean /= np.maximum(np.linalg.norm(mean, axis=1), 1e-9)[:, None]
        mean *= (n > 0)[:, None] * (RARE / (RARE + n / total))[:, None]
        return Pooling(mean.astype(np.float32))

    def features(self, text: pa.Array) -> np.ndarray:
        """(rows, DIM + 1)."""
        cut, row = text_parts(text)
        h, n = tokens(cut)
        row = np.repeat(row, n)
        out, many = np.zeros((len(text), DIM)), np.bincount(row, minlength=len(text))
        for at in range(0, len(h), 1 << 14):
            own = row[at : at + (1 << 14)]
            begins = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[begins]] += np.add.reduceat(self.vectors[slot(h[at : at + (1 << 14)])], begins, axis=0)
        out /= np.maximum(many, 1)[:, None]
        return np.concatenate([out, np.log1p(many)[:, None]], 1)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        return np.tanh((x - self.mean) / self.scale @ w + b) @ v + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def constant(share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(DIM + 1), np.ones(DIM + 1), [np.zeros((DIM + 1, 1)), np.zeros(1), np.zeros(1), np.array([np.log(share / (1 - share))])])


def gradient(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy."""
    w, b, v, c = weights
    hidden = np.tanh(x @ w + b)
    off = (1 / (1 + np.exp(-np.clip(hidden @ v + c[0], -30, 30))) - y) / len(y)
    back = off[:, None] * v * (1 - hidden**2)
    return [x.T @ back, back.sum(0), hidden.T @ off, np.array([off.sum()])]


def cross_entropy(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fitted(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Network:
    """On the rows that are not held back; the temperature on those that are."""
    own, label = x[~held], y[~held]
    if not len(own) or label.min() == label.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    model = Network(own.mean(0), np.maximum(own.std(0), 1e-9), [])
    z, rng = (own - model.mean) / model.scale, np.random.default_rng(7)
    weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    best, model.weights = np.inf, weights
    for t in range(1, EPOCHS + 1):
        for i, g in enumerate(gradient(weights, z, label)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g**2
            step = first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
            weights[i] = weights[i] - RATE * (step + (DECAY * weights[i] if weights[i].ndim == 2 else 0))
        loss = cross_entropy(Network(model.mean, model.scale, weights).logits(x[held]), y[held]) if held.any() else 0.0
        if loss <= best:
            best, model.weights = loss, list(weights)
    if held.any():
        logits, label = model.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
        model.temperature = float(grid[np.argmin([cross_entropy(logits / t, label) for t in grid])])
    return model


def fit(docs: DataFrame, labels: DataFrame, most: dict[int, int] = SAMPLE) -> tuple[Pooling, Network]:
    """Word vectors of all documents and the network; ``most`` labelled documents of each class are learned from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    pooling = Pooling.of(context_sums(docs))
    shipped = spark.sparkContext.broadcast(pooling)
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_of_id("doc_id") % 5 != 0))
        .groupBy(F.col("doc_id").cast("long").alias("known"))
        .agg(F.max("quality").cast("int").alias("label"))
    )
    sample = None
    for label in (0, 1):  # top-k by hash
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("known"), "known").limit(most[label])
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(F.broadcast(sample), F.col("doc") == F.col("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(3), PART):
                x = shipped.value.features(b.column(3).slice(lo, hi - lo)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:3]), pa.array([r.tobytes() for r in x], pa.binary())], ["doc", "label", "hash", "x"])

    pooled = map_batches(texts.select("doc", "label", F.xxhash64("text"), "text"), run, "doc long, label int, hash long, x binary")
    rows = sorted(pooled.groupBy("doc", "label").agg(F.min(F.struct("hash", "x")).alias("of")).select("doc", "label", "of.x").collect())  # at most the sample
    x = np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float64).reshape(len(rows), DIM + 1)
    held = mix(np.array([r[0] for r in rows], np.int64).view(U)) % U(5) == 0 if rows else np.zeros(0, bool)
    return pooling, fitted(x, np.array([r[1] for r in rows], np.float64), held)


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(crc_of_id("doc_id") % 5 == 0, F.lit(False)), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooling, network = shipped.value
        for b in batches:
            for lo, hi in slices(b.column(2), PART):
                score = network.score(pooling.features(b.column(2).slice(lo, hi - lo)))
                predicted = pa.array((score >= THRESHOLD).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:2]), pa.array(score), predicted], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")
