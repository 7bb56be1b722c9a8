"""Media columns as progressive JPEG.

The decoder takes baseline-precision progressive files (SOF2, Huffman): it accumulates spectral-selection and
successive-approximation scans into coefficient arrays, inverse-transforms them with one integer-valued matrix product,
upsamples chroma by repetition, converts to RGB and gives full-resolution tensors.

Entropy-coded data is decoded in lockstep: every restart interval of every file of a batch is a lane with a bit
position, and one numpy step decodes one symbol of all lanes that share scan parameters and tables. A file without
restart intervals is one lane, decoded alike.

``store_payloads`` keeps arbitrary bytes losslessly: a byte b is the coefficient 256 + b (so it is non-zero at every
precision), 64 bytes are a block, six blocks (four of luma, two of chroma) a 16 x 16 unit; the payload's length is in a
comment segment. Reading back decodes the file with the same decoder and takes the bytes from the coefficients.

All arithmetic is on integers (in float64 where exact), so equal inputs give equal outputs in any batch.

Defined results: a null text is an empty payload, which is padded to 192 spaces; equal texts give equal files;
repeated rows give equal rows; an empty table gives an empty result; other columns are ignored; a damaged file raises
``JpegError``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .textnum import raw_bytes, slices

UNIT = 192  # payloads are padded to multiples of this
PAD = 32
INTERVAL = 4  # blocks (or units, in interleaved scans) of a restart interval
COLUMNS = 64  # units in a row, at least, of files of more than one row
CHUNK = 2 << 20
NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


class JpegError(ValueError):
    pass


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    cells = sorted(((i + j, i if (i + j) % 2 else j, i * 8 + j) for i in range(8) for j in range(8)))
    return np.array([c[2] for c in cells])


def inverse_matrix() -> np.ndarray:
    """(64 zigzag coefficients, 64 samples): the inverse DCT in units of 2^-13, rounded to integers."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    both = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.rint(both[zigzag()] * 8192)


INVERSE = inverse_matrix()


# ---------------------------------------------------------------- files


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks that scans of this component alone have
    high: int = 0
    stride: int = 0  # blocks that whole units have
    rows: int = 0
    base: int = 0  # first block in the file's coefficients


@dataclass
class Scan:
    parts: tuple[int, ...]
    tables: tuple[bytes, ...]
    band: tuple[int, int]
    high: int
    low: int
    interval: int
    data: tuple[int, int]


@dataclass
class File:
    width: int
    height: int
    parts: list[Component]
    scans: list[Scan]
    quants: dict[int, np.ndarray]
    comment: bytes
    blocks: int
    units: tuple[int, int]

    def layout(self) -> tuple:
        return (self.width, self.height, *((c.h, c.v) for c in self.parts))


def parse(raw: bytes) -> File:
    """Headers and scans of a progressive file."""
    if raw[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    at, quants, tables, interval, comment = 2, {}, {}, 0, b""
    parts: list[Component] = []
    scans: list[Scan] = []
    width = height = 0
    units = (0, 0)
    while True:
        if at + 2 > len(raw) or raw[at] != 0xFF:
            raise JpegError("no marker where one must be")
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        if at + 4 > len(raw):
            raise JpegError("cut short")
        size = struct.unpack_from(">H", raw, at + 2)[0]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 << wide
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not width or not height or n not in (1, 3):
                raise JpegError("unsupported frame")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hm, vm = max(c.h for c in parts), max(c.v for c in parts)
            units = (-(-width // (8 * hm)), -(-height // (8 * vm)))
            base = 0
            for c in parts:
                c.wide, c.high = -(-width * c.h // (8 * hm)), -(-height * c.v // (8 * vm))
                c.stride, c.rows, c.base = units[0] * c.h, units[1] * c.v, base
                base += c.stride * c.rows
        elif 0xC0 <= marker <= 0xCF:
            raise JpegError("not a progressive Huffman file")
        elif marker == 0xDA:
            n = body[0]
            idents = [c.ident for c in parts]
            which = tuple(idents.index(body[1 + 2 * i]) for i in range(n))
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            used = tuple(tables.get(body[2 + 2 * i] >> 4 if ss == 0 else 0x10 | body[2 + 2 * i] & 15, b"") for i in range(n))
            end = NEXT_MARKER.search(raw, at)
            if end is None:
                raise JpegError("no end of image")
            scans.append(Scan(which, used, (ss, se), approx >> 4, approx & 15, interval, (at, end.start())))
            at = end.start()
    if not parts:
        raise JpegError("no frame")
    last = parts[-1]
    return File(width, height, parts, scans, quants, comment, last.base + last.stride * last.rows, units)


_LOOKUPS: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol for every 16-bit window; length 0 where no code fits."""
    if table not in _LOOKUPS:
        length, symbol = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)
        code, at = 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                lo = code << (16 - n)
                length[lo : lo + (1 << (16 - n))], symbol[lo : lo + (1 << (16 - n))] = n, table[at]
                code, at = code + 1, at + 1
            code <<= 1
        _LOOKUPS[table] = (length, symbol)
    return _LOOKUPS[table]


# ---------------------------------------------------------------- entropy decoding in lockstep


def windows(data: np.ndarray) -> np.ndarray:
    """The 64 bits from each byte on."""
    x = np.concatenate([data, np.full(16, 0xFF, np.uint8)]).astype(np.uint64)
    n = len(data) + 8
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | x[k : k + n]
    return out


class Lanes:
    """Bit positions of all lanes of a group of scans, over unstuffed data."""

    def __init__(self, chunks: list[bytes], expected: np.ndarray):
        size = np.array([len(c) for c in chunks])
        raw = np.frombuffer(b"".join(chunks), np.uint8)
        scan = np.repeat(np.arange(len(chunks)), size)
        ff = raw[:-1] == 0xFF if len(raw) else np.zeros(0, bool)
        same = scan[1:] == scan[:-1]
        follows = np.zeros(len(raw), bool)
        follows[1:] = ff & same
        stuffed = follows & (raw == 0)
        restart = follows & (raw >= 0xD0) & (raw <= 0xD7)
        keep = ~stuffed & ~restart
        keep[:-1] &= ~restart[1:]
        self.data = np.concatenate([raw[keep], np.full(16, 0xFF, np.uint8)])
        kept = np.concatenate([[0], np.cumsum(keep)])
        begin = np.sort(np.concatenate([np.cumsum(size) - size, np.flatnonzero(restart) + 1]))
        n = np.bincount(scan[restart], minlength=len(chunks)) + 1 if len(raw) else np.ones(len(chunks), int)
        if not np.array_equal(n, expected):
            raise JpegError("restart markers do not match the restart interval")
        self.bits = kept[begin].astype(np.int64) * 8
        self.windows = windows(self.data[:-16])

    def peek(self, at: np.ndarray) -> np.ndarray:
        byte = np.minimum(at >> 3, len(self.windows) - 1)
        return self.windows[byte] << (at & 7).astype(np.uint64)

    def bit(self, at: np.ndarray) -> np.ndarray:
        byte = np.minimum(at >> 3, len(self.data) - 1)
        return (self.data[byte] >> (7 - (at & 7)).astype(np.uint8)) & 1


ONE, TOP = np.uint64(1), np.uint64(63)


def following(window: np.ndarray, used: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ``n`` bits after the first ``used``; 0 for n = 0."""
    return (((window << used) >> ONE) >> (TOP - n.astype(np.uint64))).astype(np.int64)


def extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value that ``size`` magnitude bits stand for."""
    half = np.left_shift(1, np.maximum(size - 1, 0))
    return np.where((bits < half) & (size > 0), bits - 2 * half + 1, bits)


def symbols(window: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code = (window >> np.uint64(48)).astype(np.int64)
    used = table[0][code]
    if not used.all():
        raise JpegError("a code that no table has")
    return used, table[1][code]


def dc_first(lanes: Lanes, order: np.ndarray, first: np.ndarray, count: np.ndarray, pattern: np.ndarray, tables: list, low: int, coefs: np.ndarray) -> None:
    """order: blocks unit by unit; first, count: of each lane's blocks; pattern: the component of a unit's blocks."""
    at, pred = lanes.bits.copy(), np.zeros((int(pattern.max()) + 1, len(first)), np.int64)
    live = np.arange(len(first))
    for k in range(int(count.max()) if len(count) else 0):
        live = live[count[live] > k]
        part = int(pattern[k % len(pattern)])
        w = lanes.peek(at[live])
        used, size = symbols(w, tables[part])
        pred[part, live] += extended(following(w, used, size), size)
        at[live] += used.astype(np.int64) + size
        coefs[order[first[live] + k], 0] = pred[part, live] << low


def dc_refine(lanes: Lanes, order: np.ndarray, first: np.ndarray, count: np.ndarray, low: int, coefs: np.ndarray) -> None:
    which = np.repeat(np.arange(len(first)), count)
    k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    coefs[order[first[which] + k], 0] |= (lanes.bit(lanes.bits[which] + k).astype(np.int16) << low).astype(np.int16)


def ac_first(lanes: Lanes, order: np.ndarray, first: np.ndarray, count: np.ndarray, table: tuple, band: tuple[int, int], low: int, coefs: np.ndarray) -> None:
    ss, se = band
    at, block, end = lanes.bits.copy(), first.copy(), first + count
    k = np.full(len(first), ss)
    while len(at):
        w = lanes.peek(at)
        used, sym = symbols(w, table)
        run, size = sym >> 4, sym & 15
        value = size > 0
        if value.all():
            extra = following(w, used, size)
            k += run
            if (k > se).any():
                raise JpegError("a run beyond its band")
            coefs[order[block], k] = extended(extra, size) << low
            at += used.astype(np.int64) + size
            k += 1
        else:
            n = np.where(value, size, np.where(run < 15, run, 0))
            extra = following(w, used, n)
            at += used.astype(np.int64) + n
            k = np.where(value, k + run, k)
            if (k[value] > se).any():
                raise JpegError("a run beyond its band")
            coefs[order[block[value]], k[value]] = extended(extra, size)[value] << low
            k = np.where(value, k + 1, np.where(run == 15, k + 16, k))
            ends = ~value & (run < 15)
            block = np.where(ends, block + np.left_shift(1, np.where(ends, run, 0)) + extra, block)
            k[ends] = ss
        full = k > se
        if full.any():
            block = block + full
            k[full] = ss
        if (block >= end).any():
            live = block < end
            at, block, end, k = at[live], block[live], end[live], k[live]


def ac_refine(lanes: Lanes, order: np.ndarray, first: np.ndarray, count: np.ndarray, table: tuple, band: tuple[int, int], low: int, coefs: np.ndarray) -> None:
    ss, se = band
    at, block, end = lanes.bits.copy(), first.copy(), first + count
    k, left = np.full(len(first), ss), np.zeros(len(first), np.int64)
    place = np.arange(64)

    def correct(rows: np.ndarray, who: np.ndarray, upto: np.ndarray) -> None:
        """Correction bits of the non-zero coefficients of ``rows`` from k to before ``upto``."""
        held = coefs[rows]
        old = (held != 0) & (place >= k[who, None]) & (place < upto[:, None])
        rank = np.cumsum(old, 1)
        bit = lanes.bit(at[who, None] + rank - 1).astype(bool) & old
        coefs[rows] = np.where(bit, held + (np.sign(held) << low), held)
        at[who] += rank[:, -1]

    while len(at):
        ask = np.flatnonzero(left == 0)
        if len(ask):
            w = lanes.peek(at[ask])
            used, sym = symbols(w, table)
            run, size = sym >> 4, sym & 15
            if (size > 1).any():
                raise JpegError("a refinement of more than a bit")
            ends = (size == 0) & (run < 15)
            n = np.where(ends, run, size)
            extra = following(w, used, n)
            at[ask] += used.astype(np.int64) + n
            left[ask[ends]] = np.left_shift(1, run[ends]) + extra[ends]
            go = ~ends
            if go.any():
                who, rows = ask[go], order[block[ask[go]]]
                zero = (coefs[rows] == 0) & (place >= k[who, None]) & (place <= se)
                hit = (np.cumsum(zero, 1) == run[go, None] + 1) & zero
                stop = np.where(hit.any(1), hit.argmax(1), se + 1)
                correct(rows, who, stop)
                new = (size[go] == 1) & (stop <= se)
                coefs[rows[new], stop[new]] = np.where(extra[go][new] == 1, 1, -1) << low
                k[who] = stop + 1
        through = np.flatnonzero(left > 0)
        if len(through):
            correct(order[block[through]], through, np.full(len(through), se + 1))
            left[through] -= 1
            k[through] = se + 1
        full = k > se
        block = block + full
        k[full] = ss
        if (block >= end).any():
            live = block < end
            at, block, end, k, left = at[live], block[live], end[live], k[live], left[live]


_ORDERS: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def block_order(f: File, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks in a scan's order, relative to the file's first, and the component of each block of a unit."""
    key = (*f.layout(), parts)
    if key not in _ORDERS:
        if len(parts) == 1:
            c = f.parts[parts[0]]
            order = c.base + (np.arange(c.high)[:, None] * c.stride + np.arange(c.wide)).reshape(-1)
            pattern = np.zeros(1, int)
        else:
            cols, rows = f.units
            cells, pattern = [], []
            for i, p in enumerate(parts):
                c = f.parts[p]
                for y in range(c.v):
                    for x in range(c.h):
                        cells.append(c.base + (np.arange(rows)[:, None] * c.v + y) * c.stride + np.arange(cols) * c.h + x)
                        pattern.append(i)
            order, pattern = np.stack([c.reshape(-1) for c in cells], 1).reshape(-1), np.array(pattern)
        if len(_ORDERS) > 4096:
            _ORDERS.clear()
        _ORDERS[key] = (order, pattern)
    return _ORDERS[key]


def decode_coefficients(raws: list[bytes]) -> tuple[list[File], np.ndarray, np.ndarray]:
    """Files, all their blocks' coefficients (zigzag order), and each file's first block."""
    files = [parse(r) for r in raws]
    base = np.concatenate([[0], np.cumsum([f.blocks for f in files])]).astype(np.int64)
    coefs = np.zeros((int(base[-1]), 64), np.int16)
    for turn in range(max((len(f.scans) for f in files), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, f in enumerate(files):
            if turn < len(f.scans):
                s = f.scans[turn]
                shape = tuple((f.parts[p].h, f.parts[p].v) for p in s.parts) if len(s.parts) > 1 else ()
                groups.setdefault((len(s.parts), shape, s.tables, s.band, s.high, s.low), []).append(i)
        for (n_parts, _, tables, band, high, low), members in groups.items():
            orders, pattern, lane_count = [], None, []
            lanes_of = np.zeros(len(members), int)
            for m, i in enumerate(members):
                f, s = files[i], files[i].scans[turn]
                order, pattern = block_order(f, s.parts)
                orders.append(order + base[i])
                unit = len(pattern)
                step = s.interval * unit if s.interval else len(order)
                n = -(-len(order) // step)
                c = np.full(n, step)
                c[-1] = len(order) - step * (n - 1)
                lane_count.append(c)
                lanes_of[m] = n
            count = np.concatenate(lane_count)
            first = np.cumsum(count) - count
            order = np.concatenate(orders)
            lanes = Lanes([raws[i][slice(*files[i].scans[turn].data)] for i in members], lanes_of)
            if band[0] == 0:
                if high:
                    dc_refine(lanes, order, first, count, low, coefs)
                else:
                    dc_first(lanes, order, first, count, pattern, [lookup(t) for t in tables], low, coefs)
            elif n_parts != 1:
                raise JpegError("an interleaved scan of AC coefficients")
            elif high:
                ac_refine(lanes, order, first, count, lookup(tables[0]), band, low, coefs)
            else:
                ac_first(lanes, order, first, count, lookup(tables[0]), band, low, coefs)
    return files, coefs, base


# ---------------------------------------------------------------- samples


def samples(coefs: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 8, 8) samples of 0 to 255."""
    x = (coefs * quant) @ INVERSE
    return np.clip(np.floor((x + 4096) / 8192) + 128, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def rgb_of(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """JFIF colours, in 16-bit fixed point."""
    y, cb, cr = y.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    r = y + ((91881 * cr + 32768) >> 16)
    g = y - ((22554 * cb + 46802 * cr + 32768) >> 16)
    b = y + ((116130 * cb + 32768) >> 16)
    return np.clip(np.stack([r, g, b], -1), 0, 255).astype(np.uint8)


def plane(f: File, c: Component, coefs: np.ndarray) -> np.ndarray:
    """A component at full resolution."""
    s = samples(coefs[c.base : c.base + c.stride * c.rows], f.quants[c.quant])
    flat = s.reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8)
    hm, vm = max(p.h for p in f.parts), max(p.v for p in f.parts)
    return flat.repeat(vm // c.v, 0).repeat(hm // c.h, 1)[: f.height, : f.width]


def decode_rgb(raw: bytes) -> np.ndarray:
    """The (height, width, 3) tensor of a file."""
    (f,), coefs, _ = decode_coefficients([raw])
    planes = [plane(f, c, coefs) for c in f.parts]
    return rgb_of(*planes) if len(planes) == 3 else np.repeat(planes[0][..., None], 3, -1)


# ---------------------------------------------------------------- payloads


def huffman(lengths: dict[int, list[int]]) -> bytes:
    return bytes(len(lengths.get(n, ())) for n in range(1, 17)) + bytes(x for n in range(1, 17) for x in lengths.get(n, ()))


DC_TABLE = huffman({4: list(range(12))})
FIRST_TABLE = huffman({1: [0x08], 2: [0x00]})
REFINE_TABLE = huffman({1: [0x00]})
BANDS = ((1, 5), (6, 63))


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def scan_header(parts: list[tuple[int, int]], ss: int, se: int, high: int, low: int) -> bytes:
    return segment(0xDA, bytes([len(parts), *(x for p in parts for x in p), ss, se, high << 4 | low]))


TABLES = (
    segment(0xDB, bytes([0]) + bytes([1] * 64))
    + segment(0xC4, bytes([0x00]) + DC_TABLE + bytes([0x10]) + FIRST_TABLE + bytes([0x11]) + REFINE_TABLE)
    + segment(0xDD, struct.pack(">H", INTERVAL))
)


def assembled(body: np.ndarray, valid: np.ndarray, lane_scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lanes (rows of ``body``, ``valid`` bytes each) with stuffing and restart markers, and scans' offsets."""
    take = np.arange(body.shape[1]) < valid[:, None]
    raw = body[take]
    new = np.concatenate([[True], lane_scan[1:] != lane_scan[:-1]])
    number = np.arange(len(valid)) - np.flatnonzero(new)[np.cumsum(new) - 1]  # of the lane in its scan
    wide = 1 + (raw == 0xFF)
    lane = np.repeat(np.arange(len(valid)), valid)
    marks = np.cumsum(~new) * 2
    pos = np.cumsum(wide) - wide + marks[lane]
    out = np.zeros(int(wide.sum()) + int(marks[-1]), np.uint8)
    out[pos] = raw
    begin = np.concatenate([[0], np.cumsum(wide)])[np.cumsum(valid) - valid] + marks
    inner = np.flatnonzero(~new)
    out[begin[inner] - 2] = 0xFF
    out[begin[inner] - 1] = 0xD0 + (number[inner] - 1) % 8
    return out, np.append(begin[new], len(out))


def packed(bits: np.ndarray, lane: np.ndarray, slot: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks' bits put in their lanes, the rest ones, as bytes; and the valid bytes of each lane."""
    room = np.ones((lanes, INTERVAL, bits.shape[1]), np.uint8)
    room[lane, slot] = bits
    n = np.bincount(lane, minlength=lanes)
    return np.packbits(room.reshape(lanes, -1), 1), -(-n * bits.shape[1] // 8)


def lanes_of(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lane and slot of each of the files' blocks in scan order, and each lane's file."""
    n = -(-blocks // INTERVAL)
    k = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return np.repeat(np.cumsum(n) - n, blocks) + k // INTERVAL, k % INTERVAL, np.repeat(np.arange(len(n)), n)


def geometry(payload_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and rows of 16 x 16 units that hold so many bytes."""
    units = -(-payload_bytes // (6 * 64))
    cols = np.minimum(units, np.maximum(COLUMNS, -(-units // 4095)))
    return cols, -(-units // cols)


def store_payloads(flat: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """A progressive file for each payload (bytes offs[i] to offs[i + 1])."""
    size = np.diff(offs)
    cols, rows = geometry(size)
    units = cols * rows
    base = np.concatenate([[0], np.cumsum(units * 6)])
    values = np.zeros(int(base[-1]) * 64, np.uint8)
    values[np.arange(len(flat)) + np.repeat(base[:-1] * 64 - offs[:-1], size)] = flat
    values = values.reshape(-1, 64)
    n_files = len(size)
    pieces: list[tuple[bytes, np.ndarray, np.ndarray]] = []
    # blocks of each component in raster order
    spans = [(base[:-1], units * 4), (base[:-1] + units * 4, units), (base[:-1] + units * 5, units)]
    rows_of = [np.arange(n.sum()) + np.repeat(b - (np.cumsum(n) - n), n) for b, n in spans]
    # blocks unit by unit: four of luma, two of chroma
    unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    file = np.repeat(np.arange(n_files), units)
    ux, uy = unit % cols[file], unit // cols[file]
    luma = [base[file] + (2 * uy + y) * 2 * cols[file] + 2 * ux + x for y in (0, 1) for x in (0, 1)]
    by_unit = np.stack([*luma, base[file] + 4 * units[file] + unit, base[file] + 5 * units[file] + unit], 1)
    lane, slot, lane_file = lanes_of(units)
    # DC: differences of the upper bits, from 0 at each lane's start
    dc = 128 + (values[by_unit, 0] >> 1).astype(np.int64)
    before = np.zeros_like(dc)
    before[:, 1:4] = dc[:, 0:3]
    inner = np.flatnonzero(slot > 0)
    before[inner, 0], before[inner, 4], before[inner, 5] = dc[inner - 1, 3], dc[inner - 1, 4], dc[inner - 1, 5]
    diff = dc - before
    many = np.where(diff == 0, 0, np.floor(np.log2(np.maximum(np.abs(diff), 1))).astype(np.int64) + 1)
    code = (many << many) | np.where(diff < 0, diff + (1 << many) - 1, diff)
    length = (4 + many).reshape(-1)
    code = code.reshape(-1)
    lane6 = np.repeat(lane, 6)
    ends = np.cumsum(length)
    new = np.concatenate([[True], lane6[1:] != lane6[:-1]])
    at = ends - length - (ends - length)[np.flatnonzero(new)][lane6]
    total = np.bincount(lane6, weights=length).astype(np.int64)
    bits = np.ones((len(total), int(-(-total.max() // 8) * 8)), np.uint8)
    for j in range(12):
        m = length > j
        bits[lane6[m], at[m] + j] = (code[m] >> (length[m] - 1 - j)) & 1
    ids = [1, 2, 3]
    pieces.append((scan_header([(i, 0) for i in ids], 0, 0, 0, 1), *assembled(np.packbits(bits, 1), -(-total // 8), lane_file)))
    places = [lanes_of(n) for _, n in spans]
    for ss, se in BANDS:
        for c in range(3):
            # nine bits a coefficient: the one-bit code of (run 0, size 8), then its upper eight bits
            v = 128 + (values[rows_of[c], ss : se + 1] >> 1)
            b = np.zeros((*v.shape, 9), np.uint8)
            b[..., 1:] = np.unpackbits(v[..., None], axis=-1)
            b = b.reshape(len(v), -1)
            ln, sl, lf = places[c]
            pieces.append((scan_header([(ids[c], 0)], ss, se, 0, 1), *assembled(*packed(b, ln, sl, int(ln[-1]) + 1), lf)))
    for c in range(3):
        # the one-bit code of an end of block, then the lowest bit of each coefficient
        b = values[rows_of[c]] & 1
        b[:, 0] = 0
        ln, sl, lf = places[c]
        pieces.append((scan_header([(ids[c], 1)], 1, 63, 1, 0), *assembled(*packed(b, ln, sl, int(ln[-1]) + 1), lf)))
    pieces.append((scan_header([(i, 0) for i in ids], 0, 0, 1, 0), *assembled(*packed(values[by_unit, 0] & 1, lane, slot, int(lane[-1]) + 1), lane_file)))
    views = [(head, memoryview(body.tobytes()), ends.tolist()) for head, body, ends in pieces]
    out = []
    for i, (n, w, h) in enumerate(zip(size.tolist(), cols.tolist(), rows.tolist(), strict=True)):
        frame = struct.pack(">BHHB", 8, h * 16, w * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [b"\xff\xd8", segment(0xFE, b"payload %d" % n), TABLES, segment(0xC2, frame)]
        for head, body, ends in views:
            parts += [head, body[ends[i] : ends[i + 1]]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def read_payloads(raws: list[bytes]) -> tuple[list[bytes], list[str]]:
    """Payload and feature of each file: its size and its mean red, green and blue over the full-resolution tensor."""
    files, coefs, base = decode_coefficients(raws)
    values = (coefs - 256).astype(np.uint8).reshape(-1)
    payloads = []
    for i, f in enumerate(files):
        word = f.comment.split()
        if len(word) != 2 or word[0] != b"payload":
            raise JpegError("not a payload's file")
        payloads.append(values[base[i] * 64 : base[i] * 64 + int(word[1])].tobytes())
    s = samples(coefs, np.ones(64))
    # per unit: 16 x 16 luma, and chroma repeated twice each way
    units = np.diff(base) // 6
    file = np.repeat(np.arange(len(files)), units)
    unit = np.arange(len(file)) - np.repeat(np.cumsum(units) - units, units)
    cols = np.array([f.units[0] for f in files])[file]
    luma = [s[base[file] + (2 * (unit // cols) + y) * 2 * cols + 2 * (unit % cols) + x] for y in (0, 1) for x in (0, 1)]
    y = np.concatenate([np.concatenate(luma[:2], 2), np.concatenate(luma[2:], 2)], 1)
    cb, cr = (s[base[file] + k * units[file] + unit].repeat(2, 1).repeat(2, 2) for k in (4, 5))
    sums = np.add.reduceat(rgb_of(y, cb, cr).sum((1, 2), dtype=np.int64), np.cumsum(units) - units, axis=0) if len(file) else np.zeros((0, 3), np.int64)
    features = []
    for f, (r, g, b), n in zip(files, sums.tolist(), units.tolist(), strict=True):
        mean = [f"{x * 1000 // (n * 256) / 1000:.3f}" for x in (r, g, b)]
        features.append(f"{f.width}x{f.height}:{','.join(mean)}")
    return payloads, features


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' bytes with spaces appended up to a positive multiple of UNIT: bytes, offsets, and sizes without padding."""
    body, offs = raw_bytes(texts)
    size = np.diff(offs)
    full = np.maximum(-(-size // UNIT), 1) * UNIT
    at = np.concatenate([[0], np.cumsum(full)])
    flat = np.full(int(at[-1]), PAD, np.uint8)
    flat[np.arange(len(body)) + np.repeat(at[:-1] - offs[:-1], size)] = body
    return flat, at, size


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_table(docs: DataFrame) -> DataFrame:
    """Store each whole text, read it back, and describe both."""
    bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1), CHUNK):
                flat, offs, size = padded(b.column(1).slice(lo, hi - lo))
                media = store_payloads(flat, offs)
                back, feature = read_payloads(media)
                columns = [
                    b.column(0).slice(lo, hi - lo),
                    pa.array(size),
                    pa.array([len(x) for x in back], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    pa.array([zlib.crc32(x[-16:]) for x in back], pa.int64()),
                    pa.array([len(x) for x in media], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in media]),
                    pa.array(feature),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def rgb_tensors(media: DataFrame, key: str = "doc_id", column: str = "media", damaged: str = "flag") -> DataFrame:
    """(key, height, width, rgb, damaged) of a column of progressive files: full-resolution tensors, row-major, 3 bytes a pixel.

    A file that cannot be decoded has null for a tensor and is flagged, or ends the job with ``damaged='raise'``.
    """
    bounded_batches(media.sparkSession)
    source = media.select(key, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(1)[i].as_py()
                t, bad = None, False
                try:
                    t = None if raw is None else decode_rgb(raw)
                except Exception:
                    if damaged == "raise":
                        raise
                    bad = True
                shape = (None, None) if t is None else t.shape[:2]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 1), pa.array([shape[0]], pa.int32()), pa.array([shape[1]], pa.int32()), pa.array([None if t is None else t.tobytes()], pa.binary()), pa.array([bad])],
                    [key, "height", "width", "rgb", "damaged"],
                )

    return source.mapInArrow(run, f"`{key}` {source.dtypes[0][1]}, height int, width int, rgb binary, damaged boolean")
