"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A text's ``k`` most frequent character n-grams (1 to 3) are ranked and compared with each language's ranked
profile: an n-gram's distance is the difference of its ranks, or ``k`` where the profile lacks it. The language
of least total distance is predicted.

Characters fall in 64 classes: 0 for all that is no letter (runs of them count once), 1 to 26 for a to z, and 27
to 63, by a multiplicative rule, for other letters. An n-gram is hence an integer below 2^20.

Profiles are counted over every training row's whole text: tasks send sums per language and n-gram, which
Spark adds up; a bounded number (``k`` for each language) reaches the driver, and as many go out to the tasks.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for every text when there is
nothing to learn from; ties of counts go to the smaller n-gram, ties of distance to the first language in order;
repeated rows are scored alike; rows with a null language teach nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_batches, crc_of_id, map_batches, named

K = 400
GRAMS = 3
SIZE = 1 << 20  # two bits of n, 18 bits of classes
HELD = 1 << 22  # n-grams held before they are counted

_CLASS: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """The class of each code point of the first plane."""
    if not _CLASS:
        t = np.zeros(1 << 16, np.uint8)
        t[[c for c in range(1 << 16) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = 255
        other = np.flatnonzero(t)
        t[other] = 27 + (other * 40503 >> 7) % 37
        t[97:123] = np.arange(1, 27)
        _CLASS.append(t)
    return _CLASS[0]


def encode(text: str) -> np.ndarray:
    """The text's character classes, runs of non-letters as one 0, with a 0 at either end."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = char_classes()[np.minimum(cp, 0xFFFF)]
    high = np.flatnonzero(cp > 0xFFFF)
    if len(high):
        c[high] = [27 + (int(x) * 40503 >> 7) % 37 if chr(x).isalpha() else 0 for x in cp[high]]
    c = np.concatenate([[0], c, [0]]).astype(np.uint32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    return c[keep]


def grams(c: np.ndarray) -> np.ndarray:
    """All 1-, 2- and 3-grams of a class sequence but the lone 0."""
    one = c[c > 0]
    two = (c[:-1] << np.uint32(6)) | c[1:]
    three = (two[:-1] << np.uint32(6)) | c[2:]
    tag = [np.uint32(n << 18) for n in (1, 2, 3)]
    return np.concatenate([one | tag[0], two | tag[1], three | tag[2]])


def counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(g)
    at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[at], np.diff(np.append(at, len(g)))


class Sums:
    """Sorted n-grams with their counts, added to in bulk."""

    def __init__(self) -> None:
        self.key, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, grams: np.ndarray) -> None:
        self.held.append(grams)
        self.size += len(grams)
        if self.size > HELD:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        g = np.sort(np.concatenate(self.held))
        at = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
        key = np.concatenate([self.key, g[at]])
        n = np.concatenate([self.n, np.diff(np.append(at, len(g)))])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        self.key, self.n = key[at], np.add.reduceat(n, at) if len(at) else n
        self.held, self.size = [], 0


def ranked(text: str, k: int = K) -> np.ndarray:
    """The text's ``k`` most frequent n-grams in order of rank; empty without a letter."""
    c = encode(text)
    if not c.any():
        return np.zeros(0, np.uint32)
    g, n = counted(grams(c))
    if len(g) > k:  # the k-th count, then all above it and the smallest n-grams among its equals
        cut = np.partition(n, len(n) - k)[len(n) - k]
        keep = n > cut
        ties = np.flatnonzero(n == cut)[: k - keep.sum()]
        keep[ties] = True
        g, n = g[keep], n[keep]
    return g[np.argsort(-n, kind="stable")]


def profiles(train: DataFrame, k: int = K) -> dict[str, np.ndarray]:
    """The ranked n-grams of each language over all rows of ``train`` (lang, text)."""
    bounded_batches(train.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Sums] = {}
        size = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = encode(text.as_py())
                if c.any():
                    sums.setdefault(lang, Sums()).add(grams(c))
                    size += 3 * len(c)
                    if size > HELD:  # of all languages together
                        for s in sums.values():
                            s.settle()
                        size = 0
        for lang, s in sums.items():
            s.settle()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(s.key)), pa.array(s.key.astype(np.int32)), pa.array(s.n)], ["lang", "gram", "n"]
            )

    sums = (
        train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", "text")
        .mapInArrow(count, "lang string, gram int, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = sums.withColumn("r", rank).filter(F.col("r") <= k).select("lang", "gram", "r").collect()
    out: dict[str, np.ndarray] = {}
    for lang in sorted({r[0] for r in top}):
        mine = sorted((r[2], r[1]) for r in top if r[0] == lang)
        out[lang] = np.array([g for _, g in mine], np.uint32)
    return out


class Profiles:
    """The languages' ranked n-grams, by n-gram: where each one's entries begin, and their languages and ranks.

    Besides a table of fixed size there are at most ``k`` entries for each language.
    """

    def __init__(self, found: dict[str, np.ndarray], k: int):
        self.names, self.k = list(found), k
        gram = np.concatenate([np.zeros(0, np.int64), *found.values()]).astype(np.int64)
        lang = np.repeat(np.arange(len(found)), [len(g) for g in found.values()])
        rank = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in found.values()]]).astype(np.int64)
        order = np.argsort(gram, kind="stable")
        self.lang, self.rank = lang[order].astype(np.int32), rank[order].astype(np.int32)
        self.at = np.searchsorted(gram[order], np.arange(SIZE + 1)).astype(np.int32)

    def distances(self, g: np.ndarray) -> np.ndarray:
        """The out-of-place distance of ranked n-grams to each language."""
        lo = self.at[g]
        n = self.at[g.astype(np.int64) + 1] - lo
        place = np.repeat(np.arange(len(g)), n)
        entry = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        saved = self.k - np.minimum(np.abs(self.rank[entry] - place), self.k)
        return self.k * len(g) - np.bincount(self.lang[entry], saved, len(self.names)).astype(np.int64)


def identify(docs: DataFrame, found: dict[str, np.ndarray], k: int = K, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score: 1 - the least distance's share of the greatest possible one."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(Profiles(found, k))
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    out = docs.select(*[named(c) for c in keep], "text")
    schema = StructType(out.schema.fields[:-1]).add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for b in batches:
            pred, score = [], []
            for text in b.column(b.num_columns - 1):
                g = ranked(text.as_py() or "", k)
                if not len(g) or not known.names:
                    pred.append("und")
                    score.append(0.0)
                    continue
                d = known.distances(g)
                best = int(d.argmin())
                pred.append(known.names[best])
                score.append(float(1 - d[best] / (k * len(g))))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"]
            )

    return map_batches(out, predict, schema)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(crc_of_id(doc_id) % F.lit(folds) == F.lit(fold), F.lit(False))


def language_table(docs: DataFrame, k: int = K) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod 3 is not 1 and predict all."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    flagged = ids.withColumn("held_out", held_out(F.col("doc_id")))
    found = profiles(flagged.filter(~F.col("held_out")), k)
    return identify(flagged.select("doc_id", "held_out", "text"), found, k)
