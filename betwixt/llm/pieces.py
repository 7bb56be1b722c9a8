"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

The vocabulary of a public SentencePiece model is used as it is. A text's lattice has an edge for each piece that
matches at a place, and for each character that is no piece of its own one edge of byte pieces. Forward filtering sums
the weights of all segmentations up to each place; backward sampling then draws one segmentation from its end, with
probability proportional to the product of its pieces' weights to the power ``alpha``.

The public model is a BPE model whose scores are negative merge ranks, not log probabilities. A piece of rank r gets
the Zipfian weight 1 / (r + 2), normalised over the vocabulary; user-defined pieces count as rank 0, a byte piece as
the last rank.

No piece holds a space after another character, and none a newline, so a lattice falls apart at those places into
independent segments: exactly, not as an approximation. Distinct segments of a chunk share one forward pass; each
occurrence is sampled on its own. Segments of more than ``LONG`` bytes fall apart further, at places that no piece
crosses, and so do texts of more than ``CHUNK`` bytes, which are encoded part by part. A run of more than ``RUN`` bytes that
pieces cross everywhere is filtered block by block: a place's sum needs those of the places a longest piece before it
only, and its draw needs no more, so that what is kept of a run is each place's draw, five bytes. The random number of each step is a hash of the row key and the place in the text, so a row's
result depends neither on batches, partitions and retries nor on where its lattice was cut. Sums that could leave the
range of a double carry binary exponents, so any ``alpha`` works.

Decoding joins the pieces' bytes and drops the leading space that encoding adds: any text, also with literal U+2581
(which encodes as bytes), comes back byte for byte.

Defined results: a null or empty text has no pieces (null ids for null); a null key seeds as 0; repeated rows get equal
results; an empty table gives an empty result; other columns are kept if asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import bounded_batches, map_batches, named
from .textnum import BASE, U, mix, powers, raw_bytes, slices, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = 64  # bytes
CHUNK = 1 << 16  # of text in a chunk, which costs some 500 bytes of working memory a byte
BATCH = "1m"  # of an Arrow batch: workers hold one beside a chunk
RUN, BLOCK = 1 << 13, 1 << 11
SPACE, NEWLINE = 0x20, 0x0A
SPREAD = U(0x9E3779B97F4A7C15)
BITS = 18


@dataclass
class Vocabulary:
    """Pieces as bytes (with a plain space for the space mark), their ids and log weights; ids of the 256 bytes."""

    pieces: list[bytes]
    ids: np.ndarray
    logs: np.ndarray
    byte_ids: np.ndarray
    byte_log: float
    size: int
    tables: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        """What tasks need: the tables, not the pieces they were made of."""
        return self.__dict__ | {"pieces": [], "lookup": {}}

    def ready(self) -> Vocabulary:
        """With its tables, which are built on the driver, once."""
        if self.tables:
            return self
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(self.pieces):
            by_length.setdefault(len(p), []).append(i)
        for n in range(1, max(by_length) + 1):
            which = by_length.get(n, [])
            h = np.array([poly(self.pieces[i]) for i in which], U)
            order = np.argsort(h)
            # bit 1: the hash of a piece of this length; bit 2: of a prefix of a longer one
            seen = np.zeros(1 << BITS, np.uint8)
            seen[slot(h)] = 1
            longer = {p[:n] for p in self.pieces if len(p) > n}
            seen[slot(np.array([poly(p) for p in longer], U))] |= 2
            self.tables[n] = (h[order], np.array(which, np.int64)[order], seen)
        self.lookup = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(by_length)
        # bytes of every id, for decoding
        length = np.zeros(self.size, np.int64)
        raw: list[bytes] = [b""] * self.size
        for i, p in zip(self.ids.tolist(), self.pieces, strict=True):
            raw[i] = p
        for b, i in enumerate(self.byte_ids.tolist()):
            raw[i] = bytes([b])
        length[:] = [len(x) for x in raw]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum(length)[:-1]])
        self.raw_length = length
        return self


def slot(h: np.ndarray) -> np.ndarray:
    return (h * SPREAD >> U(64 - BITS)).astype(np.int64)


def poly(piece: bytes) -> int:
    return sum((c + 1) * pow(BASE, k, 1 << 64) for k, c in enumerate(piece)) & 0xFFFFFFFFFFFFFFFF


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read on the driver; what is broadcast is bounded by the model's size."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    mark = "▁"
    pieces, ids, ranks, byte_ids = [], [], [], np.zeros(256, np.int64)
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            piece = sp.id_to_piece(i).replace(mark, " ").encode()
            if not piece or NEWLINE in piece or b" " in piece.lstrip(b" "):
                raise ValueError(f"piece {i} may not cross a space or newline")
            pieces.append(piece)
            ids.append(i)
            ranks.append(max(0.0, -sp.get_score(i)) if sp.get_score(i) > -1e6 else 0.0)
    weight = 1 / (np.array(ranks) + 2)
    logs = np.log(weight / weight.sum())
    return Vocabulary(pieces, np.array(ids), logs, byte_ids, float(logs.min()), n).ready()


def uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each row's seed and place in the text."""
    return (mix(seed + place.astype(U) * U(0xD1342543DE82EF95)) >> U(11)).astype(np.float64) * 2.0**-53


def row_seeds(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ U(0x5EED))


def segment_begins(buf: np.ndarray) -> np.ndarray:
    """Where a newline is, or something after one, or a space after another character: no piece crosses these places."""
    space, newline = buf == SPACE, buf == NEWLINE
    begins = newline.copy()
    begins[1:] |= newline[:-1] | (space[1:] & ~space[:-1])
    return begins


def char_ends(buf: np.ndarray) -> np.ndarray:
    """For each byte that starts a character: where it ends. Other bytes stand alone."""
    n = np.ones(len(buf), np.int64)
    lead = buf >= 0xC0
    want = np.where(buf >= 0xF0, 4, np.where(buf >= 0xE0, 3, 2))
    follow = np.concatenate([(buf & 0xC0) == 0x80, [False] * 4])
    at = np.flatnonzero(lead)
    got = np.ones(len(at), np.int64)
    going = np.ones(len(at), bool)
    for k in range(1, 4):
        going &= (want[at] > k) & follow[at + k]
        got += going
    n[at] = np.where(got == want[at], got, 1)
    return np.arange(len(buf)) + n


def edges_of(buf: np.ndarray, seg_end: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of all lattice edges; piece -1 is a character in bytes. seg_end: of each place's segment."""
    n = len(buf)
    up, down = powers(n + 1)
    run = np.zeros(n + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[:n], out=run[1:])
    starts, ends, pieces = [], [], []
    narrow = np.int32 if n < 1 << 29 else np.int64  # edges are the bulk of the working memory
    whole_char = np.zeros(n, bool)
    char_end = char_ends(buf)
    # places whose text so far begins some longer piece, as long as the segment goes on
    end, base, scale, places = seg_end.astype(narrow), run[:-1], down[:n], np.arange(n, dtype=narrow)
    for length, (keys, which, seen) in v.tables.items():
        h = (run[places + length] - base) * scale
        found = seen[slot(h)]
        go = np.flatnonzero((found & 2).astype(bool) & (end > places + length))
        hit = np.flatnonzero(found & 1) if len(keys) else np.zeros(0, np.int64)
        at, h = places[hit], h[hit]
        end, base, scale, places = end[go], base[go], scale[go], places[go]
        if not len(hit):
            if not len(places):
                break
            continue
        pos = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        good = keys[pos] == h
        at, pos = at[good], pos[good]
        starts.append(at)
        ends.append(at + length)
        pieces.append(which[pos].astype(narrow))
        whole_char[at[char_end[at] == at + length]] = True
    is_start = np.zeros(n, bool)
    cut = (buf & 0xC0) != 0x80
    is_start[cut] = True
    # a stray continuation byte stands alone; those inside a character do not
    inside = np.zeros(n + 4, np.int8)
    lead = np.flatnonzero(char_end - np.arange(n) > 1)
    for k in range(1, 4):
        m = lead[char_end[lead] > lead + k]
        inside[m + k] = 1
    is_start |= inside[:n] == 0
    own = np.flatnonzero(is_start & ~whole_char)
    starts.append(own.astype(narrow))
    ends.append(np.minimum(char_end[own], seg_end[own]).astype(narrow))
    pieces.append(np.full(len(own), -1, narrow))
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces)


def uncrossed(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the places 0 to n lie inside no edge."""
    change = np.bincount(start + 1, minlength=n + 2)[: n + 2] - np.bincount(end, minlength=n + 2)[: n + 2]
    return np.cumsum(change)[: n + 1] == 0


class Encoder:
    def __init__(self, v: Vocabulary, alpha: float):
        self.v, self.alpha = v.ready(), alpha
        # weights as mantissas and binary exponents; the last is a byte's
        x = np.append(alpha * v.logs, alpha * v.byte_log) / math.log(2)
        self.exponent = np.floor(x).astype(np.int64)
        self.mantissa = np.exp2(x - self.exponent)
        self.weight = np.ldexp(self.mantissa, np.maximum(self.exponent, -2000).astype(np.int32))
        bits = max(1.0, -float(x.min()))
        self.plain = int(800 / bits) if bits <= 30 else 0  # bytes for which plain doubles do

    def lattice(self, buf: np.ndarray, first: np.ndarray, edges: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """(from, to, piece, to + cumulative probability, start) of the edges of units that lie one after another in ``buf``.

        Place i + unit number is a node: a unit of n bytes has n + 1 nodes. Edges are in the order of the node that they
        lead to, then of their length.
        """
        size = np.diff(first)
        start, end, piece = edges
        s = (np.searchsorted(first, start, "right") - 1).astype(start.dtype)
        order = np.argsort((end.astype(np.int64) + s) * (self.v.longest + 5) + (end - start), kind="stable")
        start, end, piece, s = start[order], end[order], piece[order], s[order]
        del order, edges
        node_from, node_to, length = start + s, end + s, end - start
        rel = (end - first[s]).astype(np.int32)
        del end, s
        w = np.where(piece >= 0, self.weight[piece], self.weight[-1] ** length)
        total = np.zeros(len(buf) + len(size))
        total[first[:-1] + np.arange(len(size))] = 1
        power = np.zeros(len(total), np.int64)  # total * 2 ** power
        share = np.empty(len(w))
        # all units advance a byte at a time: edges by how far from the unit's start they end
        turn = np.argsort(rel, kind="stable")
        cuts = np.searchsorted(rel[turn], np.arange(1, (int(size.max()) if len(size) else 0) + 2))
        for step, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), 1):
            if a == b:
                continue
            now = turn[a:b]
            to = node_to[now]
            new = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            if step <= self.plain:
                x = total[node_from[now]] * w[now]
                total[to[new]] = np.add.reduceat(x, new)
                share[now] = x  # divided below, all at once
                continue
            p, many = piece[now], np.diff(np.append(new, len(now)))
            x = total[node_from[now]] * np.where(p >= 0, self.mantissa[p], self.mantissa[-1] ** length[now])
            e = power[node_from[now]] + self.exponent[p] * np.where(p >= 0, 1, length[now])
            x, more = np.frexp(x)
            e += more
            top = np.maximum.reduceat(e, new)
            x = np.ldexp(x, np.maximum(e - np.repeat(top, many), -2000).astype(np.int32))
            sums = np.add.reduceat(x, new)
            share[now] = x / np.repeat(sums, many)
            total[to[new]], power[to[new]] = sums, top
        early = rel <= self.plain
        share[early] /= total[node_to[early]]
        # running sums in each node, with the last exactly 1
        run = np.cumsum(share)
        head = np.flatnonzero(np.concatenate([[True], node_to[1:] != node_to[:-1]]))
        before = np.concatenate([[0.0], run])[head]
        cum = run - np.repeat(before, np.diff(np.append(head, len(run))))
        cum = np.minimum(cum, 1.0)
        cum[np.append(head[1:], len(run)) - 1] = 1.0
        return node_from, node_to, piece, node_to + cum, start

    def encode(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, their offsets by row, and the bytes that were encoded (a space before each text), with offsets."""
        body, offs = raw_bytes(texts)
        size = np.diff(offs)
        filled = size > 0
        added = np.cumsum(filled)
        buf = np.full(len(body) + int(added[-1]) if len(added) else 0, SPACE, np.uint8)
        row = np.repeat(np.arange(len(size)), size)
        buf[np.arange(len(body)) + added[row]] = body
        boffs = offs + np.concatenate([[0], added])
        seeds = row_seeds(keys)
        if len(size) > 1 or len(buf) <= 2 * CHUNK:
            whole = self.sampled(buf, boffs, seeds, 0)
            if whole is not None:
                return *whole, buf, boffs
        parts = [self.by_parts(buf[a:b], seeds[i]) for i, (a, b) in enumerate(zip(boffs[:-1], boffs[1:], strict=True))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), buf, boffs

    def by_parts(self, buf: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """ids of one text, by parts that no edge crosses and by long runs."""
        ids, at = [np.zeros(0, np.int32)], 0
        while at < len(buf):
            to = self.part_end(buf, at)
            if to:
                ids.append(self.sampled(buf[at:to], np.array([0, to - at]), seed[None], at)[0])
            else:
                run, to = self.run(buf, at, seed)
                ids.append(run)
            at = to
        return np.concatenate(ids)

    def uncrossed_after(self, buf: np.ndarray, at: int, to: int) -> np.ndarray:
        """The places beyond ``at``, up to ``to``, that no edge crosses; none does ``at``."""
        part = buf[at : to + self.v.longest + 4]
        start, end, _ = edges_of(part, np.full(len(part), len(part)), self.v)
        # an edge that the part's end cuts off is missing only if it starts after ``to``
        return at + 1 + np.flatnonzero(uncrossed(len(part), start, end)[1 : to - at + 1])

    def part_end(self, buf: np.ndarray, at: int) -> int:
        """The last place, at most ``CHUNK`` bytes on, that no edge crosses, with no long run before it; 0 where a long run begins here."""
        to = min(at + CHUNK, len(buf))
        free = self.uncrossed_after(buf, at, to)
        if to == len(buf):
            free = np.append(free[free < to], to)
        far = np.flatnonzero(np.diff(np.concatenate([[at], free, [to]])) > RUN)
        if len(far):
            return int(free[far[0] - 1]) if far[0] else 0
        return int(free[-1]) if len(free) else 0

    def run(self, buf: np.ndarray, at: int, seed: np.ndarray) -> tuple[np.ndarray, int]:
        """ids of the run that begins at ``at``, up to the first place that no edge crosses; and that place."""
        wide, bits = self.v.longest, max(1.0, -float((self.exponent + np.log2(self.mantissa)).min()))
        calm = int(900 / bits) - wide  # places in a row whose sums fit in doubles beside those of a longest piece
        plain, calm = calm > 0, max(1, min(calm, 64))
        logs = np.log(self.mantissa) + self.exponent * math.log(2)
        window = np.zeros(wide) if plain else np.full(wide, -np.inf)
        window[-1] = 1.0 if plain else 0.0
        back, what, pos, end = [], [], at, None
        while end is None:
            to = min(pos + BLOCK, len(buf))
            lo = max(at, pos - wide - 4)
            while lo > at and pos - lo < wide + 8 and buf[lo] & 0xC0 == 0x80:
                lo -= 1
            part = buf[lo : to + wide + 4]
            start, stop, piece = edges_of(part, np.full(len(part), len(part)), self.v)
            start, stop = start.astype(np.int64) + lo, stop.astype(np.int64) + lo
            inner = (start >= max(at, pos - wide)) & (start < to)
            start, stop, piece = start[inner], stop[inner], piece[inner].astype(np.int64)
            # places from pos + 1 to ``to`` that no edge crosses: the first one ends the run
            depth = np.bincount(np.maximum(start, pos) - pos + 1, minlength=to - pos + wide + 6) - np.bincount(np.maximum(stop, pos) - pos, minlength=to - pos + wide + 6)
            free = np.flatnonzero(np.cumsum(depth)[1 : to - pos + 1] == 0)
            n = int(free[0]) + 1 if len(free) else to - pos
            if len(free) or to == len(buf):
                end = pos + n
            here = (stop > pos) & (stop <= pos + n)
            start, stop, piece = start[here], stop[here], piece[here]
            row, col = stop - pos - 1, wide - (stop - start)
            kind = np.full((n, wide), -1)
            kind[row, col] = piece
            weight = np.zeros((n, wide)) if plain else np.full((n, wide), -np.inf)
            length = stop - start
            weight[row, col] = np.where(piece >= 0, self.weight[piece], self.weight[-1] ** length) if plain else np.where(piece >= 0, logs[piece], logs[-1] * length)
            share, sums = np.zeros((n, wide)), np.empty(wide + n)
            sums[:wide] = window
            for a in range(0, n, calm):
                b = min(n, a + calm)
                if plain:
                    for j in range(a, b):
                        sums[j + wide] = np.dot(sums[j : j + wide], weight[j])
                    share[a:b] = np.lib.stride_tricks.sliding_window_view(sums[a : b + wide - 1], wide) * weight[a:b]
                    sums[b : b + wide] /= sums[b : b + wide].max()
                    continue
                for j in range(a, b):
                    x = sums[j : j + wide] + weight[j]
                    top = x.max()
                    if top > -np.inf:
                        share[j] = np.exp(x - top)
                    sums[j + wide] = top + math.log(share[j].sum()) if top > -np.inf else -np.inf
            window = sums[n:]
            window = window / window.max() if plain else window - window.max()
            # shortest first; the last edge takes what rounding leaves
            order = share[:, ::-1]
            cum = np.cumsum(order, 1)
            draw = uniform(np.full(n, seed), np.arange(pos + 1, pos + n + 1)) * cum[:, -1]
            pick = np.minimum((cum <= draw[:, None]).sum(1), wide - 1 - np.argmax(order[:, ::-1] > 0, 1))
            back.append((pick + 1).astype(np.uint8))
            what.append(kind[np.arange(n), wide - 1 - pick].astype(np.int32))
            pos += n
        steps, place, ends = np.concatenate(back).tobytes(), end - at, []
        while place:
            ends.append(place)
            place -= steps[place - 1]
        ends = np.array(ends[::-1])
        piece = np.concatenate(what)[ends - 1]
        size = np.where(piece >= 0, 1, np.frombuffer(steps, np.uint8)[ends - 1])
        ids = np.repeat(np.where(piece >= 0, self.v.ids[piece], -1), size)
        # characters in bytes
        first = np.cumsum(size) - size
        for k in np.flatnonzero(piece < 0).tolist():
            ids[first[k] : first[k] + size[k]] = self.v.byte_ids[buf[at + ends[k] - size[k] : at + ends[k]]]
        return ids.astype(np.int32), end

    def sampled(self, buf: np.ndarray, boffs: np.ndarray, seeds: np.ndarray, origin: int) -> tuple[np.ndarray, np.ndarray] | None:
        """ids, and their offsets by row, of rows that lie one after another; the first starts ``origin`` bytes into its text.

        None if there is a long run among them.
        """
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(boffs), np.int64)
        begins = segment_begins(buf)
        begins[boffs[:-1][np.diff(boffs) > 0]] = True
        begin = np.flatnonzero(begins)
        end = np.append(begin[1:], len(buf))
        doc = np.searchsorted(boffs, begin, "right") - 1
        _, sample, which = np.unique(span_hashes(buf, begin, end), return_index=True, return_inverse=True)
        length = (end - begin)[sample]
        first = np.concatenate([[0], np.cumsum(length)])
        flat = buf[np.arange(first[-1]) - np.repeat(first[:-1] - begin[sample], length)]
        edges = edges_of(flat, np.repeat(first[1:], length), self.v)
        # units: the distinct segments, the long ones further apart
        cut = np.zeros(len(flat) + 1, bool)
        cut[first] = True
        if (length > LONG).any():
            cut[:-1] |= uncrossed(len(flat), *edges[:2])[:-1] & np.repeat(length > LONG, length)
        unit = np.flatnonzero(cut)
        if len(unit) > 1 and np.diff(unit).max() > max(RUN, LONG):
            return None
        of = np.searchsorted(unit, first)  # each segment's first unit
        node_from, node_to, piece, cum, start = self.lattice(flat, unit, edges)
        n_ids = np.where(piece >= 0, 1, node_to - node_from)
        # a lane for each occurrence of a unit, in the order of the text
        many = np.diff(of)[which]
        lane = np.repeat(np.arange(len(begin)), many)
        u = np.arange(len(lane)) - np.repeat(np.cumsum(many) - many, many) + of[which][lane]
        # the place in its row's text that node 0 of the lane's unit would have
        shift = begin[lane] - boffs[doc[lane]] + (unit[u] - first[which[lane]]) + origin - (unit[u] + u)
        # occurrences of a unit go together, which keeps the walks through the lattice local
        going = np.argsort(u.astype(np.int32), kind="stable")
        u = u[going]
        home, at = unit[u] + u, unit[u + 1] + u
        mine, shift = seeds[doc[lane[going]]], shift[going]
        count = np.zeros(len(lane), np.int64)
        picks: list[tuple[np.ndarray, np.ndarray]] = []
        while len(going):
            e = np.minimum(np.searchsorted(cum, at + uniform(mine, at + shift), "right"), len(cum) - 1)
            picks.append((going, e))
            count[going] += n_ids[e]
            at = node_from[e]
            more = np.flatnonzero(at != home)
            going, at, home, mine, shift = going[more], at[more], home[more], mine[more], shift[more]
        place = np.concatenate([[0], np.cumsum(count)])
        ids = np.zeros(place[-1], np.int32)
        left = place[1:].copy()
        for lanes, e in picks:
            left[lanes] -= n_ids[e]
            p = piece[e]
            one = p >= 0
            ids[left[lanes[one]]] = self.v.ids[p[one]]
            where, a, size = left[lanes[~one]], start[e[~one]], n_ids[e[~one]]
            for j in range(int(size.max()) if len(size) else 0):  # characters in bytes
                m = size > j
                ids[where[m] + j] = self.v.byte_ids[flat[a[m] + j]]
        return ids, place[np.searchsorted(lane, np.searchsorted(begin, boffs))]


def decode_bytes(ids: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' bytes joined, and the byte offset of each piece."""
    v.ready()
    size = v.raw_length[ids]
    offs = np.concatenate([[0], np.cumsum(size)])
    return v.raw[np.arange(offs[-1]) - np.repeat(offs[:-1] - v.raw_at[ids], size)], offs


def decode_texts(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> list[str]:
    """The text of each row of ids, less the space that encoding put before it."""
    raw, at = decode_bytes(ids, v)
    return [raw[at[a] : at[b]].tobytes()[1:].decode("utf-8", "surrogateescape") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def sample_encode(docs: DataFrame, keep: list[str], key: str = "doc_id", alpha: float = 0.5, model: str = MODEL) -> DataFrame:
    """``keep`` columns with n_bytes, n_pieces, ids, and lossless: the decoded ids are the text's bytes."""
    spark = docs.sparkSession
    bounded_batches(spark, BATCH)
    shipped = spark.sparkContext.broadcast(load_vocabulary(model))
    source = docs.select(*[named(c) for c in keep], named(key).cast("long"), "text")
    schema = StructType(source.schema.fields[: len(keep)]).add("n_bytes", "long").add("n_pieces", "long").add("ids", ArrayType(IntegerType())).add("lossless", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value, alpha)
        for b in batches:
            text = b.column(b.num_columns - 1)
            for lo, hi in slices(text, CHUNK):
                part = text.slice(lo, hi - lo)
                keys = np.asarray(pc.fill_null(b.column(b.num_columns - 2).slice(lo, hi - lo), 0)).astype(np.int64).view(U)
                ids, offs, buf, boffs = encoder.encode(part, keys)
                back, at = decode_bytes(ids, encoder.v)
                if len(back) == len(buf) and np.array_equal(back, buf):
                    good = np.ones(hi - lo, bool)
                else:
                    good = np.array([np.array_equal(back[at[a] : at[c]], buf[x:y]) for a, c, x, y in zip(offs[:-1], offs[1:], boffs[:-1], boffs[1:], strict=True)])
                null = np.asarray(pc.is_null(part))
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
                size = np.maximum(np.diff(boffs) - 1, 0)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in b.columns[:-2]), pa.array(size), pa.array(np.diff(offs)), lists, pa.array(good)],
                    [*keep, "n_bytes", "n_pieces", "ids", "lossless"],
                )

    return map_batches(source, run, schema)


def decode(encoded: DataFrame, keep: list[str], ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``keep`` columns with the text of each row's ids (null for null)."""
    spark = encoded.sparkSession
    bounded_batches(spark, BATCH)
    shipped = spark.sparkContext.broadcast(load_vocabulary(model))
    source = encoded.select(*[named(c) for c in keep], named(ids))
    schema = StructType(source.schema.fields[: len(keep)]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped.value.ready()
        for b in batches:
            texts = [None if x is None else decode_texts(np.array(x, np.int64), np.array([0, len(x)]), v)[0] for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return map_batches(source, run, schema)
