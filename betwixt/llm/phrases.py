"""Phrases whose words stick together, mined as in PrefixSpan (Pei et al., 2001) for contiguous patterns.

A text is cut into pieces at marks and line ends, a piece into words at blanks; A-Z are lower-cased. For each language,
a phrase of 2 to ``LONGEST`` words that occurs a >= ``LEAST`` times within pieces is a candidate. Cut after its first k
words, with l and r the occurrences of both parts, it scores floor(2 * 10^6 a / (l + r)); its lowest cut counts.
Candidates inside a longer candidate that has four fifths of their occurrences are dropped.

Words are counted first, then their extensions to the right by one word, pairs of frequent words. The projected table of
a frequent pair holds, for each of its occurrences, the words that follow it in the piece, as far as each pair of
neighbours is frequent (other patterns cannot be) and a pattern may reach: equal ones are one row with a count. Each
prefix of two words is dealt to one task. There the rows are sorted, so that the occurrences of any
longer prefix are one run of rows: a prefix's pointers are its run's bounds, its extensions to the right are the runs
inside it, and the order of the rows visits them depth first. A task therefore keeps one open run for each length,
whatever the size of the projected tables; Spark sorts and spills them. The table of a pair that has more than a
``HOT``-th of all occurrences is dealt by its prefixes of three words instead. At most ``HOT`` pairs can be that
frequent, so their list is bounded.

Which words and pairs are frequent is told by bitmaps of fixed size; others that pass them cost rows, not results, since
every count is tested. Parts of candidates are looked up by joins; the best ones of a language are picked among the best of
hashed parts, so no task ranks a language.

Within a chunk of ``CHUNK`` bytes equal rows are found by 64-bit hashes.

Defined results: a null text is empty; a null language is ``und``; repeated rows count each time; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, key_filter, map_batches, materialize, passes
from .textnum import U, mix, span_hashes

LEAST, LONGEST, KEPT = 30, 4, 2000
SHARE = (100, 80)  # a longer phrase hides a shorter one from SHARE[0] * f(longer) >= SHARE[1] * f(shorter)
SCALE = 2_000_000
HOT = 4096
CHUNK = 1 << 20  # bytes of text
ENTRIES = 1 << 18  # words that a task counts at a time
LINE, BLANK = 0x0A, 0x20
PLAIN = bytes(c + 32 if 65 <= c <= 90 else LINE if c in b".,;:!?\n\v\f\r" else BLANK if c == 9 else c for c in range(256))


def parts(data: bytes, ahead: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about ``CHUNK`` bytes, cut between words, each with the next ``ahead`` words of its piece, and where those begin."""
    at = 0
    while at < len(data):
        to = at + CHUNK
        if to >= len(data):
            yield data[at:], len(data) - at
            return
        cut = max(data.rfind(b"\n", at + 1, to), -1)
        if cut < 0:
            cut = data.rfind(b" ", at + 1, to)
        if cut < 0:  # a long word
            found = [x for x in (data.find(b"\n", to), data.find(b" ", to)) if x >= 0]
            cut = min(found, default=len(data))
        end = cut
        if data[cut : cut + 1] == b" ":
            for _ in range(ahead):
                while data[end : end + 1] == b" ":
                    end += 1
                stops = [x for x in (data.find(b"\n", end), data.find(b" ", end)) if x >= 0]
                end = min(stops, default=len(data))
        yield data[at:end], cut - at
        at = cut


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                columns = [pa.repeat(pa.scalar(lang, pa.string()), len(counts)), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
                batch = pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])
                yield from (batch.slice(at, 1 << 15) for at in range(0, len(counts), 1 << 15))
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts = held.setdefault(lang, Counter())
                for part, end in parts(text.as_py().translate(PLAIN), 0):
                    before = len(counts)
                    counts.update(part[:end].split())
                    size += len(counts) - before
                    if size > ENTRIES:
                        yield from rows()
                        counts, size = held.setdefault(lang, Counter()), 0
        yield from rows()

    return map_batches(docs, run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def lang_keys(langs: list[str]) -> np.ndarray:
    """Keys that no word's hash equals because it is spelt as the language: they are mixed once more, beside a salt."""
    buf, ends = "".join(langs).encode(), np.cumsum([len(x.encode()) for x in langs])
    return mix(span_hashes(np.frombuffer(buf, np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) + U(0xD6E8FEB86659FD93))


def then(code: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The code of a prefix with one more word."""
    return mix(code * U(0x9E3779B97F4A7C15) + key)


def codes(phrases: DataFrame) -> DataFrame:
    """``n`` and ``key``, by which tasks know a phrase, of (lang, phrase, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                known, buf, offs = laid_out(b.column(0), b.column(1))
                blank = np.flatnonzero(buf == BLANK)
                start, end = np.sort(np.append(offs[:-1], blank + 1)), np.sort(np.append(blank, offs[1:]))
                row = np.searchsorted(offs, start, "right") - 1
                key, first = mix(span_hashes(buf, start, end) ^ known[row]), np.searchsorted(row, np.arange(b.num_rows))
                code, many = key[first], np.diff(np.append(first, len(row)))
                for k in range(1, int(many.max())):
                    more = np.flatnonzero(many > k)
                    code[more] = then(code[more], key[first[more] + k])
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array(code.view(np.int64))], ["n", "key"])

    return map_batches(phrases, run, "n long, key long")


def laid_out(langs: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's key of its language; the bytes of all rows and their offsets."""
    langs, words = langs.dictionary_encode(), words.cast(pa.large_binary())
    offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    buf = np.frombuffer(words.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return lang_keys(langs.dictionary.to_pylist())[langs.indices.to_numpy()], buf, offs - offs[0]


def windows(texts: list[tuple[str, bytes, int]], frequent: np.ndarray, hot: np.ndarray, least: int) -> pa.RecordBatch:
    """A chunk's rows of projected tables: lang, words in a row that may be frequent, each with a blank behind it, their count, and the key to deal by.

    ``least`` 2: pairs, of words that pass the bitmap. 3: three words and more, in pairs that pass it.
    """
    langs = sorted({lang for lang, _, _ in texts})
    buf = np.frombuffer(b"\n".join(t for _, t, _ in texts), np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for _, t, _ in texts])
    inside = (buf != LINE) & (buf != BLANK)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(begin, start, "right") - 1
    piece = np.cumsum(buf == LINE)[start] if len(start) else start
    of_lang = np.array([langs.index(lang) for lang, _, _ in texts])[text]
    key = mix(span_hashes(buf, start, end) ^ lang_keys(langs)[of_lang])
    # whether a word and the next one may be in a pattern
    tied = np.zeros(len(start), bool)
    if len(start):
        tied[:-1] = piece[1:] == piece[:-1]
        good = passes(frequent, (key if least == 2 else then(key, np.roll(key, -1))).view(np.int64))
        tied &= good
        if least == 2:
            tied[:-1] &= good[1:]
    many, going = np.ones(len(start), np.int64), tied
    for k in range(1, 2 if least == 2 else LONGEST):
        many += going
        going = going & np.append(tied[k:], np.zeros(min(k, len(tied)), bool))
    limit = begin[:-1] + np.array([n for _, _, n in texts], np.int64)
    first = np.flatnonzero((many >= least) & (start < limit[text]))
    many = many[first]
    code = then(key[first], key[first + 1])
    deal = code.copy()
    split = np.isin(code, hot)
    for k in range(2, LONGEST):
        here = np.flatnonzero(many > k)
        code[here] = then(code[here], key[first[here] + k])
        if k == 2:
            deal[split] = code[split]
    _, sample, count = np.unique(code, return_index=True, return_counts=True)
    one, many = first[sample], many[sample]
    # their words, each with a blank behind it
    word = np.repeat(one - np.cumsum(many) + many, many) + np.arange(many.sum())
    size = end[word] - start[word] + 1
    ends = np.cumsum(size)
    at = np.repeat(start[word] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
    flat = np.append(buf, np.uint8(BLANK))[at]
    if len(ends):
        flat[ends - 1] = BLANK
    offs = np.concatenate([[0], ends[np.cumsum(many) - 1]]).astype(np.int32) if len(many) else np.zeros(1, np.int32)
    rows = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(offs), pa.py_buffer(flat)])
    lang = pa.DictionaryArray.from_arrays(pa.array(of_lang[one].astype(np.int32)), pa.array(langs, pa.string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([lang, rows, pa.array(count.astype(np.int64)), pa.array(deal[sample].view(np.int64))], ["lang", "words", "n", "deal"])


def projected(docs: DataFrame, frequent: np.ndarray, hot: np.ndarray, least: int) -> DataFrame:
    """The rows of all projected tables."""
    shipped = docs.sparkSession.sparkContext.broadcast((frequent, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes, int]] = []
        size = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for part, end in parts(text.as_py().translate(PLAIN), LONGEST - 1):
                    held.append((lang, part, end))
                    size += len(part)
                    if size >= CHUNK:
                        yield windows(held, *shipped.value, least)
                        held, size = [], 0
        if held:
            yield windows(held, *shipped.value, least)

    return map_batches(docs, run, "lang string, words binary, n long, deal long")


class Runs:
    """The open run of each length from three words on; rows come sorted, so a run is over when the next one begins."""

    def __init__(self) -> None:
        self.open: dict[int, tuple[str, bytes, int]] = {}

    def over(self, length: int) -> list[tuple]:
        lang, words, n = self.open.pop(length)
        return [(lang, words[:-1], length, n)] if n >= LEAST else []

    def rows(self, b: pa.RecordBatch) -> list[tuple]:
        """(lang, phrase, words, n) of the frequent runs that end in a batch of (lang, words, n)."""
        out: list[tuple] = []
        known, buf, offs = laid_out(b.column(0), b.column(1))
        n, blank = b.column(2).to_numpy(), np.flatnonzero(buf == BLANK)
        before = np.searchsorted(blank, offs)  # blanks before each row
        for length in range(3, LONGEST + 1):
            has = np.flatnonzero(np.diff(before) >= length)
            if not len(has):
                continue
            end = blank[before[has] + length - 1] + 1
            h = mix(span_hashes(buf, offs[has], end) ^ known[has])
            begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sums = np.add.reduceat(n[has], begins)

            def run(i: int) -> tuple[str, bytes]:
                at = begins[i]
                return b.column(0)[has[at]].as_py(), buf[offs[has[at]] : end[at]].tobytes()

            # the first run may go on with the open one; the last one stays open
            if length in self.open:
                if run(0) == self.open[length][:2]:
                    sums[0] += self.open[length][2]
                else:
                    out += self.over(length)
            last = len(begins) - 1
            out += [(lang, words[:-1], length, int(sums[i])) for i in np.flatnonzero(sums[:last] >= LEAST).tolist() for lang, words in [run(i)]]
            self.open[length] = (*run(last), int(sums[last]))
        return out

    def rest(self) -> list[tuple]:
        return [x for length in list(self.open) for x in self.over(length)]


def grown(rows: DataFrame) -> DataFrame:
    """(lang, phrase, words, n) of all frequent phrases of three words and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()

        def made(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.binary(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds, strict=True)], ["lang", "phrase", "words", "n"])

        for b in batches:
            if b.num_rows and (found := runs.rows(b)):
                yield made(found)
        if found := runs.rest():
            yield made(found)

    dealt = rows.repartition("deal").sortWithinPartitions("lang", "words").select("lang", "words", "n")
    return map_batches(dealt, run, "lang string, phrase binary, words int, n long")


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    words = materialize(word_counts(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("all_n"))
    frequent = words.filter(F.col("n") >= LEAST)
    rows = projected(texts, key_filter(codes(frequent), F.col("key")), np.zeros(0, U), 2)
    pairs = rows.groupBy("lang", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    pairs = materialize(pairs.selectExpr("lang", "substring(words, 1, octet_length(words) - 1) AS phrase", "n"), "pairs")
    keys = codes(pairs)
    every = words.agg(F.sum("n")).first()[0] or 0
    hot = keys.filter(F.col("n") * HOT > every).select("key").toArrow().column(0).to_numpy()  # fewer than HOT
    rows = projected(texts, key_filter(keys, F.col("key")), hot.view(U), 3)
    found = grown(rows).unionByName(pairs.select("lang", "phrase", F.lit(2).alias("words"), "n"))
    found = materialize(found.withColumn("phrase", F.col("phrase").cast("string")), "candidates")

    # the lowest cut of each candidate
    known = found.select("lang", "phrase", "n").unionByName(frequent.select("lang", F.col("word").cast("string").alias("phrase"), "n"))
    cuts = found.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.selectExpr("lang", "phrase", "a", "k", "array_join(slice(w, 1, k), ' ') AS head", "array_join(slice(w, k + 1, size(w) - k), ' ') AS tail")
    for part, n in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("n").alias(n)), ["lang", part])
    score = f"CAST(a AS DECIMAL(20, 0)) * {SCALE}BD div CAST(l + r AS DECIMAL(20, 0)) AS score"
    lowest = cuts.selectExpr("lang", "phrase", "a", "k", "l", "r", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # those inside a longer one that has most of their occurrences
    inner = "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    longer = found.filter("words > 2").select("lang", "n", "words", F.split("phrase", " ").alias("w")).select("lang", "n", F.explode(F.expr(inner)).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    own = lowest.join(most, ["lang", "phrase"], "left").filter(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * {SHARE[0]} < CAST(a AS DECIMAL(20, 0)) * {SHARE[1]}")
    own = own.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    hashed = own.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    best = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= KEPT)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= KEPT)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("all_n").alias("n"), F.col("score").cast("long").alias("score"))


ORACLE = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM s, (SELECT unnest(range(1, {LONGEST + 1})) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL
),
n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE m >= 2 AND f >= {LEAST}),
cut AS (SELECT lang, m, phrase, f, w, unnest(range(1, m)) AS k FROM c),
scored AS (
  SELECT cut.lang, cut.phrase, cut.f AS a, k, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * cut.f) // (x.f + y.f) AS score
  FROM cut JOIN g x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1 : k], ' ') JOIN g y ON y.lang = cut.lang AND y.phrase = array_to_string(w[k + 1 : cut.m], ' ')
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_of AS (SELECT c.lang, c.f, array_to_string(c.w[i : i + z - 1], ' ') AS phrase FROM c, range(2, {LONGEST}) t(z), range(1, {LONGEST}) u(i) WHERE z < c.m AND i + z - 1 <= c.m),
longer AS (SELECT lang, phrase, max(f) AS f FROM inner_of GROUP BY ALL),
own AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR {SHARE[0]} * longer.f < {SHARE[1]} * lowest.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM own)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= {KEPT}
"""
