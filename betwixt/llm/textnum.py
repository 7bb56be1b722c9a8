"""Words and word shingles of Arrow string columns as numpy arrays, without a Python object per word.

A word is a maximal run of ASCII letters, digits and non-ASCII characters, after lower-casing; all other
characters separate. Words never cross rows. Texts of up to ``CHUNK`` bytes are taken together; a longer
text is a chunk of its own and is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
BASE = 0x100000001B3  # odd, hence invertible modulo 2^64
PRIME, PRIME_BASE = (1 << 31) - 1, 0x2C1B3C6D  # of a second running sum: some texts collide modulo 2^64 whatever the base
U = np.uint64

WORD_BYTE = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD_BYTE[_lo:_hi] = True

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below n, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for k, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            x = np.full(size, b, U)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME_BASE**i and its inverse for i below n, modulo PRIME."""
    if len(_POWERS.get("prime_up", ())) < n:
        size = max(n, CHUNK + 1)
        for k, b in (("prime_up", PRIME_BASE), ("prime_down", pow(PRIME_BASE, -1, PRIME))):
            x = np.ones(size, U)
            done = 1
            while done < size:  # doubling: x[done + i] = x[i] * b**done
                more = min(done, size - done)
                x[done : done + more] = x[:more] * U(pow(b, done, PRIME)) % U(PRIME)
                done += more
            _POWERS[k] = x.astype(np.uint32)
    return _POWERS["prime_up"], _POWERS["prime_down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), elementwise."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mix1(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], U))[0])


def lowered(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:  # not UTF-8
        raw = texts.cast(pa.large_binary()).to_pylist()
        return pa.array([x.decode("utf-8", "replace").lower() for x in raw], pa.large_string())


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its rows (nulls are empty)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; never less than a row."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    h: np.ndarray  # hash of each word
    start: np.ndarray  # byte position in the chunk, of the lower-cased text
    end: np.ndarray
    first: np.ndarray  # index of each row's first word, and the count at the end
    offs: np.ndarray  # byte offsets of the rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = WORD_BYTE[buf]
    begins = w.copy()
    begins[1:] &= ~w[:-1]
    ends = w.copy()
    ends[:-1] &= ~w[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    begins[inner] = w[inner]
    ends[inner - 1] = w[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, from two running sums over the chunk: modulo 2^64 and modulo a prime."""
    up, down = powers(len(buf) + 1)
    value = buf.astype(U) + U(1)
    run = np.zeros(len(buf) + 1, U)
    np.cumsum(value * up[: len(buf)], out=run[1:])
    h = (run[end] - run[start]) * down[start] + (end - start).astype(U)
    up, down = prime_powers(len(buf) + 1)
    value *= up[: len(buf)]  # below 2^40, so that 2^24 of them add up
    np.cumsum(value if len(buf) < 1 << 24 else value % U(PRIME), out=run[1:])
    second = (run[end] - run[start]) % U(PRIME) * down[start] % U(PRIME)
    return mix(h ^ mix(second))


def words(texts: pa.Array, lower: bool = True) -> Words:
    buf, offs = raw_bytes(lowered(texts) if lower else texts)
    start, end = bounds(buf, offs)
    return Words(span_hashes(buf, start, end), start, end, np.searchsorted(start, offs), offs)


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the index of each row's first one.

    A row of fewer words, but at least one, has one shingle of all its words; a row of none has none.
    """
    n = len(w.h)
    counts = w.counts
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], many)
    h = np.zeros(len(at), U)
    for k in range(width):
        h = h * U(0x9E3779B97F4A7C15) + w.h[np.minimum(at + k, n - 1)]
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        x = 0
        for v in w.h[w.first[r] : w.first[r + 1]]:
            x = (x * 0x9E3779B97F4A7C15 + int(v)) & 0xFFFFFFFFFFFFFFFF
        h[first[r]] = x
    return mix(h), first


def doc_of(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
