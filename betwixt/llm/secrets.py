"""Secret scanning: fixed patterns, and character Markov models for what no pattern names.

Two first-order character models, of random strings and of ordinary identifiers, are trained from labelled samples; a
part of the samples is held out and sets the threshold. The models judge every token-like run outside base spans:
``CANDIDATE`` takes runs of 20 characters, and of 12 if there is a digit among them. A segment whose log-likelihood ratio of the two
models reaches the threshold is a secret, whatever else the run holds; it is taken to the nearest separators of the
run. Everything, training included, is DataFrame expressions; the only things that reach the driver are the table of
class-pair counts, whose size is fixed by the alphabet, and the threshold.

Offsets are code points, end exclusive. Matching replaces each match by itself between two marks (U+0001; such
characters of the text are first replaced by U+0002, which no pattern contains), splits at the marks and adds up
lengths; the text is passed over once for each pattern. Spans are gathered in blocks of ``BLOCK`` parts, so that a text
of very many spans is not copied over for each.

Defined results: a null or empty text has no spans and the digest of the empty string; matches of one kind do
not overlap, those of different kinds may; Markov spans never overlap base spans; repeated rows give the same
result; an empty table gives an empty result; other columns, whatever their names, are ignored by ``secret_table`` and
kept by ``redact``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, named

# Fixed values of the base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_ASSIGN = 12

#: Runs that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}|(?=[A-Za-z+/_=-]{0,18}[0-9])[A-Za-z0-9+/_=-]{12,19}"
#: Of held-out identifiers, the share that may reach the threshold, and the least threshold in nats.
FALSE_RATE = 0.001
LEAST_RATIO = 12.0
INNER = "[^+/_=-]*"  # a secret goes on to the next separator
BLOCK = 256

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
START = len(ALPHABET)
WIDTH = START + 1
MARK, STAND_IN = "\u0001", "\u0002"
SPAN = "array<struct<start:int,kind:int,end:int>>"

# Words of ordinary identifiers in the labelled sample.
WORDS = """the of and to in that this with for from are was not have they which their there about would other
user name file path index value count size list table node edge graph data text page item order price total
number string buffer stream reader writer server client request response message session account service
manager handler factory provider container document element attribute property parameter argument function
method class object array vector matrix update delete insert select create remove append default config
option setting version release build test debug error warning info status result return input output
information international development government environment organization responsible understanding
communication administration traditional characteristics representation""".split()

Spans = Column


def scanned(items: Column, state: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """Struct of the state after all items, and of what ``emit`` (arrays of type ``kind``) gave for each in turn, joined.

    Arrays are copied within a block of items only; finished blocks are kept by reference.
    """

    def cut(x: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(x, i * BLOCK + 1, F.lit(BLOCK)))

    blocks = F.transform(F.array(items), cut)[0]  # the items are worked out once

    def within(s: Column, item: Column) -> Column:
        return F.struct(step(s["state"], item).alias("state"), F.concat(s["out"], emit(s["state"], item)).alias("out"))

    def over(s: Column, block: Column) -> Column:
        found = F.aggregate(block, F.struct(s["state"].alias("state"), F.array().cast(kind).alias("out")), within)
        return F.transform(F.array(found), lambda x: F.struct(x["state"].alias("state"), F.concat(s["out"], F.array(x["out"])).alias("out")))[0]

    zero = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(blocks, zero, over, lambda s: F.struct(s["state"].alias("state"), F.flatten(s["out"]).alias("out")))


def in_parts(text: Column, pattern: str, emit: Callable[[Column, Column], Column]) -> Spans:
    """What ``emit`` (of start and text) gives for the pattern's matches, leftmost and non-overlapping, joined."""
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)  # every second one is a match
    state = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"))
    return scanned(
        parts,
        state,
        lambda s, part: F.struct((s["at"] + F.length(part)).alias("at"), (~s["hit"]).alias("hit")),
        lambda s, part: F.when(s["hit"], emit(s["at"], part)).otherwise(F.array().cast(SPAN)),
        SPAN,
    )["out"]


def span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


def marked_spans(text: Column, pattern: str, kind: int, least_group: int = 0) -> Spans:
    """Array of (start, kind, end) of the pattern's matches."""

    def emit(at: Column, part: Column) -> Column:
        found = F.array(span(at, kind, at + F.length(part)))
        if not least_group:
            return found
        return F.when(F.length(F.regexp_extract(part, pattern, 2)) >= least_group, found).otherwise(F.array().cast(SPAN))

    return in_parts(text, pattern, emit)


def constant(values: list, kind: str) -> Column:
    """An array of constants as one folded expression: an expression for each would weigh on every copy of the plan."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")


def token_classes(token: Column) -> Column:
    """The alphabet index of each character (others count as '-')."""
    table = [START - 1] * 128
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i
    codes = constant(table, "int")
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.get(codes, F.least(F.ascii(c), F.lit(127))))


def labelled_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(token, random): ``n`` random strings in the usual encodings and ``n`` ordinary identifiers.

    Both follow from the row number alone. ``n`` is the bound of the sample.
    """
    i = F.col("id")

    def draw(k: int, m: int) -> Column:
        return F.pmod(F.xxhash64(i, F.lit(k)), F.lit(m)).cast("int")

    base64 = F.base64(F.unhex(F.sha2(i.cast("string"), 512)))
    cut = F.lit(20) + draw(0, 30)
    random = (
        F.when(i % 4 == 0, F.sha1(i.cast("string")))
        .when(i % 4 == 1, F.upper(F.regexp_replace(F.substring(base64, 1, 60), "[^A-Za-z0-9]", "")))
        .otherwise(base64)
    )
    words = constant(WORDS, "string")
    w = [F.get(words, draw(k, len(WORDS))) for k in range(1, 5)]
    ordinary = (
        F.when(i % 10 == 0, F.concat_ws("_", *w))
        .when(i % 10 == 1, F.concat(w[0], *[F.initcap(x) for x in w[1:]]))
        .when(i % 10 == 2, F.upper(F.concat_ws("_", *w)))
        .when(i % 10 == 3, F.concat_ws("-", *w))
        .when(i % 10 == 4, F.concat_ws("/", *w))
        .when(i % 10 == 5, F.concat(*w))
        .when(i % 10 == 6, F.upper(F.concat(*w)))
        .when(i % 10 == 7, F.initcap(F.concat(*w)))
        .when(i % 20 == 8, F.concat_ws("_", w[0], w[1], (F.lit(1990) + draw(9, 40)).cast("string"), draw(8, 100).cast("string")))
        .when(i % 20 == 18, F.concat(w[0], w[1], draw(9, 1000).cast("string"), F.lit("-"), w[2], draw(8, 100).cast("string")))
        .otherwise(F.repeat(F.substring(F.lit("-=_/+0123456789ax"), draw(5, 17) + 1, 1), F.lit(12) + draw(6, 30)))
    )
    rows = spark.range(n)
    return rows.select(F.expr("true").alias("random"), random.substr(F.lit(1), cut).alias("token")).unionByName(
        rows.select(F.expr("false").alias("random"), ordinary.alias("token"))
    )


def held_back(token: Column) -> Column:
    """Every third sample sets the threshold and trains nothing."""
    return F.pmod(F.xxhash64(token), F.lit(3)) == 0


def train_markov(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """log p(next | char) under the random model minus that under the ordinary one, by class pair.

    Samples that are ``held_back`` do not count. The counts come back as one row for each label and pair of classes: at most 2 * 68 * 67 rows.
    """
    codes = samples.filter(F.col("token").isNotNull() & F.col("random").isNotNull() & ~held_back(F.col("token"))).select("random", token_classes(F.col("token")).alias("c"))
    pairs = codes.select(
        "random", F.explode(F.zip_with(F.concat(F.array(F.lit(START)), F.col("c")), F.col("c"), lambda a, b: a * WIDTH + b)).alias("pair")
    ).filter(F.col("pair").isNotNull())
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}

    def logs(label: bool) -> list[float]:
        out = []
        for a in range(WIDTH):
            row = [counts.get((label, a * WIDTH + b), 0) + smoothing for b in range(START)]
            total = sum(row)
            out += [math.log(x / total) for x in row] + [0.0]
        return out

    return [r - o for r, o in zip(logs(True), logs(False), strict=True)]


Model = list[float] | Column


def scores_of(model: Model) -> Column:
    return model if isinstance(model, Column) else constant(model, "double")


def beside_model(df: DataFrame, model: list[float], name: str) -> DataFrame:
    """``df`` with the model as an array in each row: one broadcast row.

    As a constant it would be spelt out at each of its places in every form of the plan that the driver keeps and reports.
    """
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(model,)], f"{name} array<double>")))


def ratio(token: Column, model: Model) -> Column:
    """Log-likelihood ratio of a token, random against ordinary."""
    table = scores_of(model)
    zero = F.struct(F.lit(START).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(
        token_classes(token),
        zero,
        lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.get(table, s["last"] * WIDTH + c)).alias("sum")),
        lambda s: s["sum"],
    )


def threshold(samples: DataFrame, model: list[float], false_rate: float = FALSE_RATE, least: float = LEAST_RATIO) -> float:
    """The ratio that the best segments of at most a share ``false_rate`` of the held-back identifiers reach, at least ``least``."""
    own = samples.filter(F.col("token").isNotNull() & ~F.col("random") & held_back(F.col("token"))).select("token")
    own = beside_model(own, model, "model")
    best = F.array_max(F.transform(segments(F.col("token"), F.col("model"), 0.001), lambda x: x["best"]))
    found = own.select(F.coalesce(best, F.lit(0.0)).alias("best")).agg(F.percentile("best", F.lit(1 - false_rate))).first()[0]
    return max(least, (found or 0.0) + 0.001)


def segments(token: Column, model: Model, least: float) -> Column:
    """Array of (start, end, best) of the segments of a token whose ratio reaches ``least``, in order.

    The running sum starts anew at 0, and where it has fallen by ``least`` from a peak that counts, so that neither
    ordinary text before a secret nor text between two of them hides one.
    """
    table = scores_of(model)
    none = F.array().cast("array<struct<start:int,end:int,best:double>>")
    zero = F.struct(
        F.lit(START).alias("last"), F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("since"),
        F.lit(0.0).alias("best"), F.lit(0).alias("start"), F.lit(0).alias("end"), none.alias("out"),
    )

    def closed(s: Column) -> Column:
        return F.when(s["best"] >= least, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["best"].alias("best"))))).otherwise(s["out"])

    def step(s: Column, c: Column) -> Column:
        total, after = s["sum"] + F.get(table, s["last"] * WIDTH + c), s["at"] + 1
        over = (total <= 0) | ((s["best"] >= least) & (total <= s["best"] - least))
        peak = total > s["best"]
        return F.struct(
            c.alias("last"),
            after.alias("at"),
            F.when(over, 0.0).otherwise(total).alias("sum"),
            F.when(over, after).otherwise(s["since"]).alias("since"),
            F.when(over, 0.0).when(peak, total).otherwise(s["best"]).alias("best"),
            F.when(peak & ~over, s["since"]).otherwise(s["start"]).alias("start"),
            F.when(peak & ~over, after).otherwise(s["end"]).alias("end"),
            F.when(over, closed(s)).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(token_classes(token), zero, step, closed)


def blanked(text: Column, base: Spans) -> Column:
    """The text with the characters of all base spans replaced by stand-ins; offsets stay."""

    def from_to(at: Column, x: Column) -> tuple[Column, Column]:
        return F.greatest(at, x["start"]), F.greatest(at, x["end"])

    def emit(at: Column, x: Column) -> Column:
        start, end = from_to(at, x)
        return F.array(F.substring(text, at + 1, start - at), F.repeat(F.lit(STAND_IN), end - start))

    found = scanned(base, F.lit(0), lambda at, x: from_to(at, x)[1], emit, "array<string>")
    whole = F.transform(F.array(found), lambda x: F.concat(F.array_join(x["out"], ""), F.substring(text, x["state"] + 1, F.length(text))))[0]
    return F.when(F.size(base) > 0, whole).otherwise(text)


def markov_spans(text: Column, base: Spans, model: Model, least: float = LEAST_RATIO) -> Spans:
    """Spans of segments that the models call random, in candidates outside base spans."""

    def emit(at: Column, part: Column) -> Column:
        def add(out: Column, x: Column) -> Column:
            before = F.length(F.regexp_extract(F.substring(part, F.lit(1), x["start"]), f"{INNER}$", 0))
            after = F.length(F.regexp_extract(F.substring(part, x["end"] + 1, F.length(part)), f"^{INNER}", 0))
            start, end = at + x["start"] - before, at + x["end"] + after
            last = F.get(out, F.size(out) - 1)
            meets = (F.size(out) > 0) & (last["end"] > start)
            joined = span(last["start"], 3, F.greatest(last["end"], end))
            return F.when(meets, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(span(start, 3, end))))

        return F.aggregate(segments(part, model, least), F.array().cast(SPAN), add)

    return in_parts(blanked(text, base), CANDIDATE, emit)


def digest_text(spans: Spans) -> Column:
    """kind:start:end, comma-joined, in the array's order."""
    names = constant(list(KINDS), "string")
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def learned(spark: SparkSession, samples: DataFrame | None) -> tuple[list[float], float]:
    """Model and threshold."""
    samples = labelled_samples(spark) if samples is None else samples
    model = train_markov(samples)
    return model, threshold(samples, model)


def with_spans(docs: DataFrame, model: list[float], least: float, names: list[str]) -> DataFrame:
    """``docs`` with columns of the given names: the clean text, and arrays of (start, kind, end), in order: assign, access, hex, base, all."""
    clean, assign, access, hexes, base, every = names
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, STAND_IN)
    found = docs.select("*", text.alias(clean))
    found = found.select(
        "*",
        marked_spans(F.col(clean), ASSIGN, 0, LEAST_ASSIGN).alias(assign),
        marked_spans(F.col(clean), ACCESS, 1).alias(access),
        marked_spans(F.col(clean), HEX, 2).alias(hexes),
    )
    found = found.withColumn(base, F.array_sort(F.concat(assign, access, hexes)))
    (table,) = fresh(found.columns, "model")
    found = beside_model(found, model, table)
    return found.withColumn(every, F.array_sort(F.concat(F.col(base), markov_spans(F.col(clean), F.col(base), F.col(table), least)))).drop(table)


NAMES = ("clean", "assign", "access", "hexes", "base", "every")


def secret_table(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Counts, digest and spans of each document's secrets."""
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), *learned(docs.sparkSession, samples), list(NAMES))
    return found.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hexes").cast("long").alias("n_hex"),
        F.sha2(digest_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        digest_text(F.col("every")).alias("spans"),
        (F.size("every") - F.size("base")).cast("long").alias("n_markov"),
    )


def redact(docs: DataFrame, samples: DataFrame | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; a null text stays null, rows all stay.

    ``n_chars``, if there, is the length of the new text where that changed.
    """
    *names, masked = fresh(docs.columns, *NAMES, "masked")
    every = F.col(names[-1])
    found = with_spans(docs, *learned(docs.sparkSession, samples), names)
    text = F.col("text")

    def emit(at: Column, x: Column) -> Column:
        return F.when(x["start"] >= at, F.array(F.substring(text, at + 1, x["start"] - at), F.lit(mask))).otherwise(F.array().cast("array<string>"))

    parts = scanned(every, F.lit(0), lambda at, x: F.greatest(at, x["end"]), emit, "array<string>")
    whole = F.transform(F.array(parts), lambda x: F.concat(F.array_join(x["out"], ""), F.substring(text, x["state"] + 1, F.length(text))))[0]
    found = found.withColumn(masked, F.when(F.size(every) > 0, whole))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.coalesce(F.col(masked), text).alias("text"))
        elif c == "n_chars":
            kind = docs.schema["n_chars"].dataType
            columns.append(F.when(F.size(every) > 0, F.length(masked).cast(kind)).otherwise(F.col("n_chars")).alias("n_chars"))
        else:
            columns.append(named(c))
    return found.select(*columns)
