"""Toxicity by a linear-chain conditional random field over words with two states, clean and toxic.

Labels exist for documents only, so token labels come first: a word, or a prefix of 4 to 6 bytes, that is far more
frequent among toxic than among clean documents of the sample marks its tokens toxic in toxic documents; all other
tokens are clean. The CRF then learns, from these tokens, weights of the word, its prefixes and its neighbours, and
of the transitions, by gradient ascent on the conditional likelihood. Forward-backward marginals of all tokens of a
whole text give the offending offsets (marginal of at least one half) and, as the probability that any token is
toxic, the document's score, which a logistic curve calibrates against the document labels.

The model is fitted on a bounded sample of labelled rows: ``SAMPLE`` documents of each class, of ``SAMPLE_BYTES`` bytes
together, in order of a hash of doc_id; one that does not fit is passed over. Everything else runs over all rows and whole texts.

A chunk's texts are one sequence whose matrices reset at each text's first word, cut into equal lanes: products of
the lanes' 2 x 2 matrices give each lane's entry state, and all lanes then run in step. This is exact for texts of
any length, and costs a few hundred numpy calls a chunk.

Defined results: null texts and texts without a word get the calibrated score of no evidence; without labelled rows
of both classes every score is the share of toxic labels (0 if none); labels that disagree on a document count as
toxic, other values than 0 and 1 are ignored; repeated rows are scored alike; other columns are ignored by
``toxicity_table`` and kept by ``reject_toxic``.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, crc_of_id, give_back, map_batches, named
from .textnum import U, Words, mix, raw_bytes, lowered, slices, span_hashes, words

SAMPLE = {0: 4800, 1: 800}
SAMPLE_BYTES = {0: 14 << 20, 1: 3 << 20}
TRAINED_CLEAN = 1600  # clean documents that the CRF is trained on; all of the sample's count for the marks
PREFIXES = (4, 5, 6)
SALTS = mix(np.arange(11, 11 + len(PREFIXES) + 3, dtype=U))  # word, prefixes, previous word, next word
FAMILIES = len(SALTS)
OWN = 1 + len(PREFIXES)  # families of the word itself
BITS = 20
CHANCE = 25.0  # about one feature in two million passes by chance
COMMON = 0.02  # rarer marks are the ordinary words of toxic documents that have near copies
FLOOR = 0.05  # marginals below are no evidence, else very long texts would add them up
STEPS = 256


def own_features(w: Words, buf: np.ndarray) -> np.ndarray:
    """(OWN, words) hashes of the word and its prefixes; a prefix as long as the word counts too."""
    rows = [w.h ^ SALTS[0]]
    for k, n in enumerate(PREFIXES):
        rows.append(span_hashes(buf, w.start, np.minimum(w.start + n, w.end)) ^ SALTS[1 + k])
    return np.stack(rows) if len(w.h) else np.zeros((OWN, 0), U)


def all_features(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(FAMILIES, words): with the neighbours of the same text; 0 at its ends."""
    word = own[0] ^ SALTS[0]
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:] = word[:-1] ^ SALTS[OWN]
    after[:-1] = word[1:] ^ SALTS[OWN + 1]
    inner = first[:-1][first[:-1] < first[1:]]
    before[inner] = U(0)
    after[first[1:][first[:-1] < first[1:]] - 1] = U(0)
    return np.concatenate([own, before[None], after[None]])


def compose(size: int, first: np.ndarray, psi: np.ndarray, step: np.ndarray, start: float, back: bool) -> np.ndarray:
    """Ratios toxic / clean of forward (or backward) messages of all tokens.

    Forward: r(t) = psi(t) (step01 + step11 r(t-1)) / (step00 + step10 r(t-1)), psi(t) * start at a text's first
    token. Backward: b(t) = (step10 + step11 q) / (step00 + step01 q) with q = psi(t+1) b(t+1); 1 at its last.
    """
    a, b, c, d = (np.empty(size) for _ in range(4))
    if back:
        nxt = np.ones(size)
        nxt[:-1] = psi[1:]
        a[:], b[:], c[:], d[:] = step[1, 1] * nxt, step[1, 0], step[0, 1] * nxt, step[0, 0]
        ends = first[1:][first[:-1] < first[1:]] - 1
        a[ends], b[ends], c[ends], d[ends] = 0, 1, 0, 1
    else:
        a[:], b[:], c[:], d[:] = psi * step[1, 1], psi * step[0, 1], step[1, 0], step[0, 0]
        begins = first[:-1][first[:-1] < first[1:]]
        a[begins], b[begins], c[begins], d[begins] = 0, psi[begins] * start, 0, 1
    lanes = -(-size // STEPS)
    pad = lanes * STEPS - size

    def laid(x: np.ndarray, fill: float) -> np.ndarray:
        x = np.concatenate([x[::-1] if back else x, np.full(pad, fill)])
        return np.ascontiguousarray(x.reshape(lanes, STEPS).T)

    a = laid(a, 1)
    b = laid(b, 0)
    c = laid(c, 0)
    d = laid(d, 1)
    p, q, r, s = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for k in range(STEPS):
        p, q, r, s = a[k] * p + b[k] * r, a[k] * q + b[k] * s, c[k] * p + d[k] * r, c[k] * q + d[k] * s
        top = 1 / (p + q + r + s)
        p, q, r, s = p * top, q * top, r * top, s * top
    entry, x = np.empty(lanes), 0.0
    for k, (p1, q1, r1, s1) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        entry[k] = x
        x = (p1 * x + q1) / (r1 * x + s1)
    out, x = np.empty((STEPS, lanes)), entry
    for k in range(STEPS):
        x = (a[k] * x + b[k]) / (c[k] * x + d[k])
        out[k] = x
    flat = out.T.reshape(-1)[:size]
    return flat[::-1] if back else flat


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -8.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # logs
    start: float = 0.0
    curve: tuple[float, float] = (0.0, 0.0)  # of the document's log odds
    seen: np.ndarray | None = None

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = np.full(features.shape[1], self.bias)
        if not len(self.keys):
            return out
        if self.seen is None:
            self.seen = np.zeros(1 << BITS, bool)
            self.seen[(self.keys >> U(64 - BITS)).astype(np.int64)] = True
        for f in features:
            hit = np.flatnonzero(self.seen[(f >> U(64 - BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, f[hit]), len(self.keys) - 1)
            good = self.keys[at] == f[hit]
            out[hit[good]] += self.weights[at[good]]
        return out

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(emission)
        if not n:
            return np.zeros(0)
        psi, step = np.exp(np.clip(emission, -30, 30)), np.exp(self.step)
        fwd = compose(n, first, psi, step, math.exp(self.start), False)
        bwd = compose(n, first, psi, step, math.exp(self.start), True)
        odds = fwd * bwd
        return odds / (1 + odds)

    def evidence(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds that some token of the text is toxic, between -8 and 12."""
        p = np.where(p >= FLOOR, np.minimum(p, 1 - 1e-12), 0.0)
        clean = np.concatenate([[0.0], np.cumsum(np.log1p(-p))])
        none = clean[first[1:]] - clean[first[:-1]]
        some = -np.expm1(none)
        return np.clip(np.log(np.maximum(some, 1e-12)) - none, -8, 12)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * evidence)))


def pick_sample(docs: DataFrame, labels: DataFrame, most: dict[int, int], most_bytes: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, own: packed features of the words) of the bounded sample, and how many labelled documents each class has."""
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_of_id("doc_id") % 5 != 0))
        .groupBy(F.col("doc_id").cast("long").alias("__id"))
        .agg(F.max("toxic").cast("int").alias("__toxic"))
    )
    totals = {r[0]: r[1] for r in known.groupBy("__toxic").count().collect()}
    first = None
    for label in (0, 1):  # top-k by hash: bounded by SAMPLE
        part = known.filter(F.col("__toxic") == label).orderBy(F.xxhash64("__id"), "__id").limit(most[label])
        first = part if first is None else first.unionByName(part)
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("__doc"), "text")
    order = F.struct(F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"))  # of rows that repeat an id, the shortest
    sizes = texts.join(F.broadcast(first), F.col("__doc") == F.col("__id")).groupBy("__id", "__toxic").agg(F.min(order).alias("row"))
    found = sizes.select("__id", "__toxic", F.xxhash64("__id"), "row.size", "row.hash").collect()  # bounded by SAMPLE
    kept = docs.sparkSession.createDataFrame(fitting(found, most_bytes), "__id long, __toxic int, __size int, __hash long")
    chosen = texts.join(F.broadcast(kept), (F.col("__doc") == F.col("__id")) & (F.octet_length("text") == F.col("__size")) & (F.xxhash64("text") == F.col("__hash")))
    chosen = chosen.groupBy("__id", "__toxic").agg(F.min("text").alias("text"))  # copies, and texts whose hashes collide

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                text = lowered(b.column(1).slice(lo, hi - lo))
                w, own = analysed(text)
                packed = [own[:, w.first[i] : w.first[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())], ["toxic", "own"])

    return chosen.select("__toxic", "text").mapInArrow(tokens, "toxic int, own binary"), totals


def fitting(found: list[tuple], most_bytes: dict[int, int]) -> list[tuple]:
    """(id, toxic, size, hash) of the rows (id, toxic, order, size, hash) that, in their order, still fit in ``most_bytes`` of their class.

    A document that does not fit is passed over; those after it are not.
    """
    left, kept = dict(most_bytes), []
    for i, toxic, _, size, text in sorted(found, key=lambda r: (r[2], r[0])):
        if size <= left[toxic]:
            left[toxic] -= size
            kept.append((i, toxic, size, text))
    return kept


def analysed(low: pa.Array) -> tuple[Words, np.ndarray]:
    """Words and own features of texts that are in lower case."""
    buf, _ = raw_bytes(low)
    w = words(low, lower=False)
    return w, own_features(w, buf)


def toxic_marks(rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Sorted features whose tokens count as toxic: 20 times as frequent among toxic documents as among clean ones."""
    docs = [list({hashlib.blake2b(own).digest(): own for t, own in rows if t == label and own.shape[1]}.values()) for label in (0, 1)]  # copies count once
    # a family at a time, which keeps the working arrays small
    return np.sort(np.concatenate([_family_marks([[own[f] for own in x] for x in docs]) for f in range(OWN)]))


def _family_marks(docs: list[list[np.ndarray]]) -> np.ndarray:
    dfs = []
    for features in docs:
        parts = [np.unique(x) for x in features]
        dfs.append(np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, U), np.zeros(0, int)))
    (clean, n_clean), (toxic, n_toxic) = dfs
    seen = [len(x) for x in docs]
    at = np.minimum(np.searchsorted(clean, toxic), max(0, len(clean) - 1))
    in_clean = np.where(clean[at] == toxic, n_clean[at], 0) if len(clean) else np.zeros(len(toxic), int)
    rate, base = n_toxic / max(1, seen[1]), in_clean / max(1, seen[0])
    # chance: twice the log-likelihood ratio of two rates against one, where the toxic one is higher
    both = (n_toxic + in_clean) / max(1, sum(seen))
    gain = 2 * (n_toxic * np.log(rate / both) + in_clean * np.log(np.maximum(base, 1e-12) / both))
    return toxic[(n_toxic >= max(3, COMMON * seen[1])) & (base <= rate / 20) & (gain >= CHANCE)]


def fit(
    docs: DataFrame, labels: DataFrame, epochs: int = 30, most: dict[int, int] = SAMPLE, most_bytes: dict[int, int] = SAMPLE_BYTES, trained_clean: int = TRAINED_CLEAN
) -> Model:
    """Train in one task: the sample is bounded, and an executor has more room for it than the driver, which gets the weights.

    ``most`` documents and ``most_bytes`` of each class are the sample; ``trained_clean`` clean ones train the CRF.
    """
    bounded_batches(docs.sparkSession)
    sample, totals = pick_sample(docs, labels, most, most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t.as_py(), np.frombuffer(own.as_buffer(), U).reshape(OWN, -1)) for b in batches for t, own in zip(*b.columns, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained(rows, totals, epochs, trained_clean))], pa.binary())], ["model"])

    found = map_batches(sample.repartition(1), run, "model binary").collect()
    return pickle.loads(bytes(found[0][0])) if found else trained([], totals, epochs, trained_clean)


def trained(rows: list[tuple[int, np.ndarray]], totals: dict[int, int], epochs: int, trained_clean: int) -> Model:
    """Of the sample's rows (toxic, features), which are given up on the way: their memory is needed."""
    rows.sort(key=lambda r: (r[0], r[1].shape[1], hashlib.blake2b(r[1]).digest()))
    model = Model()
    n = {c: sum(t == c for t, _ in rows) for c in (0, 1)}
    if not n[0] or not n[1]:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        model.curve = (math.log(max(share, 1e-6) / max(1 - share, 1e-6)), 0.0)
        return model
    marks = toxic_marks(rows)
    give_back()
    clean = [r for r in rows if r[0] == 0]
    chosen = clean[:: -(-len(clean) // trained_clean)] + [r for r in rows if r[0] == 1]
    n[0] = len(chosen) - n[1]
    first = np.concatenate([[0], np.cumsum([own.shape[1] for _, own in chosen])]).astype(np.int64)
    doc_label = np.array([t for t, _ in chosen])
    token_doc = np.repeat(np.arange(len(chosen)), np.diff(first))
    own = np.concatenate([own for _, own in chosen], 1)
    for held in (rows, clean, chosen):
        held.clear()
    give_back()
    features = all_features(own, first)
    del own
    y = np.zeros(features.shape[1], bool)
    for f in features[:OWN]:
        y |= np.isin(f, marks)
    y &= doc_label[token_doc] == 1
    # features that occur three times; the rest weigh nothing and are all number 0
    # family by family, which keeps the working arrays small
    keys, which = [np.zeros(1, U)], np.empty(features.shape, np.int32)
    for f in range(FAMILIES):
        k, inverse, n_f = np.unique(features[f], return_inverse=True, return_counts=True)
        usable = (n_f >= 3) & (k != 0)
        number = np.where(usable, np.cumsum(usable) + sum(map(len, keys)) - 1, 0).astype(np.int32)
        which[f] = number[inverse]
        keys.append(k[usable])
    del features, k, inverse, n_f, usable, number
    key = np.concatenate(keys)
    del keys
    give_back()
    w = np.zeros(len(key))
    bias, step, start = -6.0, np.zeros((2, 2)), 0.0
    grad2 = np.full(len(key), 1e-3)
    small = {"bias": 1e-3, "start": 1e-3, "step": np.full((2, 2), 1e-3)}
    begins = first[:-1][first[:-1] < first[1:]]
    inner = np.ones(len(y), bool)
    inner[begins] = False
    nxt = np.flatnonzero(inner).astype(np.int32)  # at most SAMPLE_BYTES
    prev = nxt - 1
    seen_step = np.array([[(~y[prev] & ~y[nxt]).sum(), (~y[prev] & y[nxt]).sum()], [(y[prev] & ~y[nxt]).sum(), (y[prev] & y[nxt]).sum()]])
    for _ in range(epochs):
        emission = np.full(len(y), bias)
        for f in which:
            emission += w[f]
        np.clip(emission, -30, 30, out=emission)
        psi, a = np.exp(emission), np.exp(step)
        fwd = compose(len(y), first, psi, a, math.exp(start), False)
        bwd = compose(len(y), first, psi, a, math.exp(start), True)
        off = fwd * bwd
        off /= 1 + off
        np.subtract(y, off, out=off)
        # pair marginals: alpha(i) step(i, j) psi(j) beta(j), normalised
        psi *= bwd
        q, before = psi[nxt], fwd[prev]
        del emission, psi, fwd, bwd
        share = 1 / (a[0, 0] + a[0, 1] * q + before * (a[1, 0] + a[1, 1] * q))
        pair = np.array([[a[0, 0] * share.sum(), a[0, 1] * (q @ share)], [a[1, 0] * (before @ share), a[1, 1] * ((before * q) @ share)]])
        del q, before, share
        g_step = seen_step - pair - 0.1 * step
        g = np.zeros(len(key))
        for f in which:
            g += np.bincount(f, weights=off, minlength=len(key))
        g -= 0.02 * w
        g[0] = 0
        grad2 += g**2
        w += 0.8 * g / np.sqrt(grad2)
        for name, gradient in (("bias", off.sum()), ("start", off[begins].sum() - 0.1 * start), ("step", g_step)):
            small[name] = small[name] + gradient**2
            move = 0.3 * gradient / np.sqrt(small[name])
            if name == "bias":
                bias += float(move)
            elif name == "start":
                start += float(move)
            else:
                step += move
    keep = np.flatnonzero(np.abs(w) > 0.2)
    keep = keep[np.argsort(key[keep])]
    model.keys, model.weights, model.bias, model.step, model.start = key[keep], w[keep], bias, step, start
    kept = np.where(np.abs(w) > 0.2, w, 0.0)
    emission = np.full(len(y), bias)
    for f in which:
        emission += kept[f]
    x = model.evidence(model.marginals(emission, first), first)
    weight = np.where(doc_label == 1, totals[1] / n[1], totals[0] / n[0])
    model.curve = calibrated(x, doc_label, weight / weight.mean())
    return model


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps with a little shrinkage."""
    b = np.array([0.0, 0.5])
    z = np.stack([np.ones_like(x), x], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (y - p)) - 0.01 * b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        b = b + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(b[0]), float(max(b[1], 0.0))


def scored(model: Model, text: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Score and offending spans (start:end in code points, comma-joined) of each row."""
    low = lowered(text)
    w, own = analysed(low)
    p = model.marginals(model.emissions(all_features(own, w.first)), w.first)
    score = model.score(model.evidence(p, w.first))
    spans: list[list[str]] = [[] for _ in range(len(text))]
    bad = np.flatnonzero(p >= 0.5)
    if len(bad):
        buf, _ = raw_bytes(low)
        # lower-casing keeps the number of code points, so positions hold for the text as it came
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        row = np.searchsorted(w.first, bad, "right") - 1
        base = points[w.offs[row]]
        for r, a, b in zip(row.tolist(), (points[w.start[bad]] - base).tolist(), (points[w.end[bad]] - base).tolist(), strict=True):
            spans[r].append(f"{a}:{b}")
    return score, [",".join(s) for s in spans]


def score_documents(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with score, predicted and spans."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    source = docs.select(*[named(c) for c in keep], "text")
    schema = StructType(source.schema.fields[:-1]).add("score", "double").add("predicted", "integer").add("spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.num_columns - 1)
            for lo, hi in slices(text):
                score, spans = scored(shipped.value, text.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in b.columns[:-1]), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, pa.string())],
                    [*keep, "score", "predicted", "spans"],
                )

    return map_batches(source, run, schema)


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and offending spans of every document."""
    model = fit(docs, labels)
    flagged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(crc_of_id("doc_id") % 5 == 0, F.lit(False)).alias("held_out"),
        "text",
    )
    return score_documents(flagged, model, ["doc_id", "held_out"])


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all columns, that are not predicted toxic."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(at)):
                score, _ = scored(shipped.value, b.column(at).slice(lo, hi - lo))
                yield b.slice(lo, hi - lo).filter(pa.array(score < 0.5))

    return map_batches(docs, run, docs.schema)
