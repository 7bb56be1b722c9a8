"""How far the sources of a language are apart in their words, by an inverted index with a corrected baseline.

A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the V terms that occur in
at least ``LEAST_DOCS`` of its documents. A group, (lang, source), or a whole language gives a kept term that occurs
c times in it p = 1 + floor(10^9 (c + 2) / (N + 2 V)), N being its occurrences of all kept terms. Two such numbers are
f = floor((p - q)^2 / (p + q)) apart.

Part ``pair``: the sum of f over all kept terms, for each pair of sources of a language. Most groups lack most terms,
so a pair starts at V f(za, zb), with z what a group gives a term that it lacks. The index's postings, the groups that
have a term, then correct it: a term that a alone has adds f(pa, zb) - f(za, zb), and one that both have adds
f(pa, pb) - f(pa, zb) - f(za, pb) + f(za, zb) beyond the corrections of either alone. Corrections of the first kind
depend on a's count and on zb only, so they are added up by count and then by z; zeros are not emitted.
Part ``term``: the ``TOP`` terms of a group that it has more than its language, by f.

Documents are counted where they are read, in tables of bounded size; equal terms of a language then meet. A posting
list has a row for each source and task at most, so neither a common term nor a hot source makes a hot key. The
table of groups is broadcast only if it has at most ``MOST_BROADCAST`` rows; otherwise it is joined with salt.

Products that may pass 64 bits are decimals of 38 digits; all division is of integers.

Defined results: null text, lang and source are ''; a group whose documents have no term, or a language that keeps
none, is 0 apart from the others; repeated rows count each time; a source alone in its language has no pairs; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, materialize

LEAST_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
PART = 1 << 20  # bytes of a text that are split into terms at a time
ENTRIES = 1 << 19  # terms of groups that a task holds, some 250 bytes each
MOST_BROADCAST = 100_000  # groups
SALTS = 32
TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def term_parts(text: bytes) -> Iterator[list[bytes]]:
    """The terms of the text, of a part after the other."""
    data, at = text.translate(TERMS), 0
    while at < len(data):
        to = len(data) if at + PART >= len(data) else data.rfind(b" ", at, at + PART)
        if to <= at:
            to = data.find(b" ", at + PART)
            to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def long_counts(text: bytes) -> Iterator[Counter]:
    """The counts of a text's terms in disjoint tables of at most about ``ENTRIES`` terms; a set that is too large is halved and read again."""
    todo = [(0, 1)]
    while todo:
        j, k = todo.pop()
        seen: Counter = Counter()
        for terms in term_parts(text):
            seen.update(terms if k == 1 else [t for t in terms if crc32(t) % k == j])
            if len(seen) > ENTRIES:
                todo += [(j, 2 * k), (j + k, 2 * k)]
                break
        else:
            yield seen


class Tables:
    """Occurrences and documents of the terms of each group, given up as rows when they are large."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> Iterator[pa.RecordBatch]:
        if len(text) <= PART:
            found = ((terms, set(terms)) for terms in term_parts(text))
        else:
            found = ((seen, seen.keys()) for seen in long_counts(text))
        for terms, distinct in found:
            n, docs = self.held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(terms)
            docs.update(distinct)
            self.size += len(n) - before
            if self.size > ENTRIES:
                yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        for group, (n, docs) in self.held.items():
            columns = [*(pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in group), pa.array(list(n), pa.binary())]
            counts = [pa.array(list(x), pa.int64()) for x in (n.values(), map(docs.__getitem__, n))]
            whole = pa.RecordBatch.from_arrays([*columns, *counts], ["lang", "source", "term", "n", "docs"])
            yield from (whole.slice(at, 1 << 15) for at in range(0, len(n), 1 << 15))
        self.held.clear()
        self.size = 0


def postings(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n, lang_n, head) for each kept term and source that has it; head marks one row of each term."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tables()
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                yield from held.add(lang, source, text.as_py())
        yield from held.rows()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    counted = map_batches(rows, run, "lang string, source string, term binary, n long, docs long")
    each = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    return (
        each.withColumn("lang_n", F.sum("n").over(of_term))
        .withColumn("in_docs", F.sum("docs").over(of_term))
        .withColumn("place", F.row_number().over(of_term.orderBy("source")))
        .filter(F.col("in_docs") >= LEAST_DOCS)
        .select("lang", F.col("term").cast("string").alias("term"), "source", "n", "lang_n", (F.col("place") == 1).alias("head"))
    )


def given(count: str, total: str, kept: str) -> str:
    """SQL of what a term that occurs ``count`` times is given; null where nothing is kept."""
    return f"1 + CAST({count} + 2 AS DECIMAL(20, 0)) * {SCALE}BD div nullif(CAST({total} + 2 * {kept} AS DECIMAL(20, 0)), 0)"


def apart(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so the square fits in 64 bits."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def groups_of(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(lang, source, kept, total, lang_total, zero) for each group that occurs: V, N of the group and of its language, and z."""
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = index.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = index.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("head").cast("long")).alias("kept"))
    full = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "kept"])
    return full.withColumn("zero", F.expr(given("0", "total", "kept")))


def on_lang(left: DataFrame, right: DataFrame, few: bool) -> DataFrame:
    """All rows of ``right`` (few for each language) beside those of ``left``; dealt by salt too, as a language may hold most rows."""
    if few:
        return left.join(F.broadcast(right), "lang")
    left = left.withColumn("salt", F.expr(f"pmod(xxhash64(*), {SALTS})"))
    return left.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"]).drop("salt")


def divergences(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank of both parts."""
    index = materialize(postings(docs), "postings")
    groups = materialize(groups_of(docs, index), "groups")
    few = groups.count() <= MOST_BROADCAST
    rated = index.join(F.broadcast(groups) if few else groups, ["lang", "source"]).selectExpr(
        "lang", "source", "term", "n", "zero", f"{given('n', 'total', 'kept')} AS p", f"{given('lang_n', 'lang_total', 'kept')} AS q"
    )

    # corrections of terms that a group has alone or not: by count, then by what the other group gives to a term that it lacks
    by_count = rated.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms"), F.first("p").alias("p"), F.first("zero").alias("zero"))
    others = groups.selectExpr("lang", "zero AS other").distinct()
    single = on_lang(by_count, others, few).selectExpr("lang", "source", "other", f"terms * ({apart('p', 'other')} - {apart('zero', 'other')}) AS more")
    single = single.filter("more <> 0").groupBy("lang", "source", "other").agg(F.sum("more").alias("more"))

    # corrections of terms that both groups have
    one, two = (rated.selectExpr("lang", "term", f"source AS {x}", f"p AS p{x}", f"zero AS z{x}") for x in "ab")
    both = one.join(two, ["lang", "term"]).filter("a < b").selectExpr("lang", "a", "b", f"{apart('pa', 'pb')} - {apart('pa', 'zb')} - {apart('za', 'pb')} + {apart('za', 'zb')} AS more")
    both = both.filter("more <> 0").groupBy("lang", "a", "b").agg(F.sum("more").alias("both"))

    mine = groups.selectExpr("lang", "source AS a", "kept", "zero AS za")
    pairs = on_lang(mine, groups.selectExpr("lang", "source AS b", "zero AS zb"), few).filter("a < b")
    for side, other in ("ab", "ba"):
        pairs = pairs.join(single.selectExpr("lang", f"source AS {side}", f"other AS z{other}", f"more AS more_{side}"), ["lang", side, f"z{other}"], "left")
    value = f"coalesce(kept * {apart('za', 'zb')}, 0) + coalesce(more_a, 0) + coalesce(more_b, 0) + coalesce(both, 0)"
    pairs = materialize(pairs.join(both, ["lang", "a", "b"], "left").selectExpr("lang", "a", "b", f"{value} AS value"), "pairs")
    pairs = pairs.selectExpr("lang", "a AS source", "b AS item", "value").unionByName(pairs.selectExpr("lang", "b AS source", "a AS item", "value"))

    terms = rated.filter("p > q").selectExpr("lang", "source", "term AS item", f"{apart('p', 'q')} AS value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part)) for part, x in (("pair", pairs), ("term", terms))]
    ranked[1] = ranked[1].filter(F.col("rank") <= TOP)
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT id, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d)
),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(gn.total, 0) + 2 * v.v)::HUGEINT AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (lc.n + 2)) // (ln.total + 2 * v.v)::HUGEINT AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
pair AS (
  SELECT x.lang, x.source, y.source AS item, coalesce(s.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
),
both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
