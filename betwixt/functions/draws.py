"""Counter-based random numbers: integer arithmetic on keys, equal in every engine and on every retry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 4294967296


def key(*parts: Column, seed: int = 0) -> Column:
    """A key below 2^31 from whole-number columns."""
    k = F.lit(seed).cast("long")
    for p in parts:
        k = (k * F.lit(31) + F.pmod(p.cast("long"), F.lit(67108859)) * F.lit(7919)) % F.lit(2147483647)
    return k


def uniform(k: Column) -> Column:
    """A double in [0, 1) for a key."""
    x = ((k * F.lit(2654435761) + F.lit(42)) % F.lit(MODULUS)) * F.lit(69069) + k
    return (x % F.lit(MODULUS)).cast("double") / F.lit(float(MODULUS))


def key_sql(*parts: str, seed: int = 0) -> str:
    k = f"{seed}::BIGINT"
    for p in parts:
        k = f"(({k}) * 31 + (({p}) % 67108859) * 7919) % 2147483647"
    return f"({k})"


def uniform_sql(k: str) -> str:
    return f"(((((({k}) * 2654435761 + 42) % 4294967296) * 69069 + ({k})) % 4294967296)::DOUBLE / 4294967296::DOUBLE)"


def uniform_numbers(*parts: np.ndarray, seed: int = 0) -> np.ndarray:
    """``uniform`` of ``key`` for arrays of whole numbers that are not negative."""
    k = np.full(len(parts[0]), seed, np.int64)
    for p in parts:
        k = (k * 31 + (p.astype(np.int64) % 67108859) * 7919) % 2147483647
    x = ((k * 2654435761 + 42) % MODULUS) * 69069 + k
    return (x % MODULUS) / float(MODULUS)
