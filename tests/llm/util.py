"""Small corpora with the awkward cases that every operator must take."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def changed(text: str, places: list[int]) -> str:
    w = text.split()
    for p in places:
        w[p % len(w)] = "changed"
    return " ".join(w)


def corpus() -> list[tuple]:
    """Ties, repeated rows, nulls in every column, empty, blank, short and very long texts, copies and near copies."""
    base = [prose(200, s) for s in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "s", len(base[0])), (21, base[0].upper(), "en", "s", 1), (22, changed(base[1], [5]), "en", "s", 1), (23, changed(base[1], [190]), "en", "s", 1)]
    rows += [(30, None, "en", "s", None), (31, "", None, "s", 0), (32, "", "en", None, 0), (33, "   \n", "en", "s", 4), (34, "?!", "en", "s", 2), (35, "?!", "en", "s", 2)]
    rows += [(40, "one two", "en", "s", 7), (41, "One, two!", "en", "s", 9), (42, prose(30_000, 99), "en", "s", 1), (None, base[3], "en", "s", 1), (5, base[5], "en", "s", len(base[5]))]
    rows += [(50, "x" * 70_000, "en", "s", 70_000), (51, "日本語 ▁ \u0001 é \U0001f600\r\n", "fr", "s", 12)]
    return rows


def documents(spark, rows=None):
    """With an extra column whose name clashes with inner names."""
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).selectExpr("*", "'kept' AS key", "1 AS score", "2 AS n").repartition(3)


def empty(spark):
    return documents(spark, []).limit(0)
