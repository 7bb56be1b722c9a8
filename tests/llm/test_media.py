"""Payload round trips, and the decoder against a plain one on files with zero runs, end-of-band runs and refinements."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from betwixt.llm import media
from betwixt.llm.queries import op2_progressive_jpeg

from .util import corpus, documents, empty


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def bytes(self):
        b = self.bits + [1] * (-len(self.bits) % 8)
        return bytes(np.packbits(np.array(b, np.uint8))).replace(b"\xff", b"\xff\x00")


FLAT = media.huffman({8: [x for x in range(255)]})  # every symbol but the last has an 8-bit code, equal to itself


def magnitude(v):
    n = abs(v).bit_length()
    return n, v if v > 0 else v + (1 << n) - 1


def encode(coefs, width, height, sampling, interval):
    """A plain scalar encoder. coefs: one (rows, cols, 64) zigzag array for each component, of whole units."""
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    ux, uy = -(-width // (8 * hm)), -(-height // (8 * vm))
    parts = [b"\xff\xd8", media.segment(0xDB, bytes([0]) + bytes(range(1, 65))), media.segment(0xC4, bytes([0x00]) + FLAT + bytes([0x10]) + FLAT)]
    if interval:
        parts.append(media.segment(0xDD, struct.pack(">H", interval)))
    frame = struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    parts.append(media.segment(0xC2, frame))

    def units(which):
        if len(which) == 1:
            h, v = sampling[which[0]]
            for y in range(-(-height * v // (8 * vm))):
                for x in range(-(-width * h // (8 * hm))):
                    yield [(which[0], y, x)]
        else:
            for y in range(uy):
                for x in range(ux):
                    yield [(c, y * sampling[c][1] + j, x * sampling[c][0] + i) for c in which for j in range(sampling[c][1]) for i in range(sampling[c][0])]

    def scan(which, ss, se, high, low, write):
        parts.append(media.scan_header([(c + 1, 0) for c in which], ss, se, high, low))
        groups, all_units = [], list(units(which))
        step = interval or len(all_units)
        for lo in range(0, len(all_units), step):
            b = Bits()
            write(b, all_units[lo : lo + step])
            groups.append(b.bytes())
        parts.append(b"".join(g + (bytes([0xFF, 0xD0 + i % 8]) if i < len(groups) - 1 else b"") for i, g in enumerate(groups)))

    def dc(b, us):
        pred = {}
        for u in us:
            for c, y, x in u:
                v = int(coefs[c][y, x, 0]) >> 1
                n, bits = magnitude(v - pred.get(c, 0))
                pred[c] = v
                b.put(n, 8)
                b.put(bits, n)

    def dc_low(b, us):
        for u in us:
            for c, y, x in u:
                b.put(int(coefs[c][y, x, 0]) & 1, 1)

    def shift(v, n):
        return int(np.sign(v)) * (abs(int(v)) >> n)

    def flush(b, run, tail):
        if run:
            n = run.bit_length() - 1
            b.put(n << 4, 8)
            b.put(run - (1 << n), n)
        for x in tail:
            b.put(x, 1)

    def ac(ss, se, low):
        def write(b, us):
            run = 0
            for ((c, y, x),) in us:
                zero = 0
                for k in range(ss, se + 1):
                    v = shift(coefs[c][y, x, k], low)
                    if not v:
                        zero += 1
                        continue
                    flush(b, run, [])
                    run = 0
                    while zero > 15:
                        b.put(0xF0, 8)
                        zero -= 16
                    n, bits = magnitude(v)
                    b.put(zero << 4 | n, 8)
                    b.put(bits, n)
                    zero = 0
                run += zero > 0
                if run == 0x7FFF:
                    flush(b, run, [])
                    run = 0
            flush(b, run, [])

        return write

    def ac_low(ss, se):
        def write(b, us):
            run, tail = 0, []
            for ((c, y, x),) in us:
                now = [int(v) for v in coefs[c][y, x]]
                last = max((k for k in range(ss, se + 1) if abs(now[k]) == 1), default=-1)
                zero, held = 0, []
                for k in range(ss, se + 1):
                    v = now[k]
                    if abs(v) > 1:
                        held.append(abs(v) & 1)
                        continue
                    if k <= last and zero == 15 and v == 0:
                        flush(b, run, tail)
                        run, tail = 0, []
                        b.put(0xF0, 8)
                        for h in held:
                            b.put(h, 1)
                        zero, held = 0, []
                        continue
                    if v == 0:
                        zero += 1
                        continue
                    flush(b, run, tail)
                    run, tail = 0, []
                    b.put(zero << 4 | 1, 8)
                    b.put(int(v > 0), 1)
                    for h in held:
                        b.put(h, 1)
                    zero, held = 0, []
                if zero or held:
                    run += 1
                    tail += held
            flush(b, run, tail)

        return write

    every = list(range(len(sampling)))
    scan(every, 0, 0, 0, 1, dc)
    for c in every:
        scan([c], 1, 5, 0, 1, ac(1, 5, 1))
        scan([c], 6, 63, 0, 1, ac(6, 63, 1))
    for c in every:
        scan([c], 1, 63, 1, 0, ac_low(1, 63))
    scan(every, 0, 0, 1, 0, dc_low)
    return b"".join([*parts, b"\xff\xd9"])


def random_image(seed, width, height, sampling):
    rng = np.random.default_rng(seed)
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    ux, uy = -(-width // (8 * hm)), -(-height // (8 * vm))
    out = []
    for h, v in sampling:
        c = rng.integers(-40, 41, (uy * v, ux * h, 64)) * (rng.random((uy * v, ux * h, 64)) < rng.choice([0.02, 0.2, 0.7]))
        c[..., 1:] += (rng.random((uy * v, ux * h, 63)) < 0.05).astype(int)
        c[0] = 0
        out.append(c)
    return out


def visible(c, part, f):
    """Blocks that scans of the component alone code; the rest have DC only."""
    out = c.copy()
    out[part.high :, :, 1:] = 0
    out[:, part.wide :, 1:] = 0
    return out


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("interval", [0, 3])
def test_coefficients_of_general_files(sampling, interval):
    images, raws = [], []
    for seed, (w, h) in enumerate([(8, 8), (40, 24), (37, 19)]):
        images.append(random_image(seed, w, h, sampling))
        raws.append(encode(images[-1], w, h, sampling, interval))
    files, coefs, base = media.decode_coefficients(raws)
    for f, image, b in zip(files, images, base[:-1], strict=True):
        for part, c in zip(f.parts, image, strict=True):
            got = coefs[b + part.base : b + part.base + part.stride * part.rows].reshape(part.rows, part.stride, 64)
            assert np.array_equal(got, visible(c, part, f))


def test_rgb_by_the_textbook():
    sampling = [(2, 2), (1, 1), (1, 1)]
    image = random_image(7, 37, 19, sampling)
    raw = encode(image, 37, 19, sampling, 0)
    got = media.decode_rgb(raw)
    (f,), coefs, _ = media.decode_coefficients([raw])
    assert got.shape == (19, 37, 3) and got.dtype == np.uint8
    zz = media.zigzag()
    planes = []
    for part in f.parts:
        c = coefs[part.base : part.base + part.stride * part.rows] * np.arange(1, 65)
        out = np.zeros((part.rows * 8, part.stride * 8))
        for b in range(len(c)):
            q = np.zeros(64)
            q[zz] = c[b]
            q = q.reshape(8, 8)
            for y in range(8):
                for x in range(8):
                    s = 0.0
                    for v in range(8):
                        for u in range(8):
                            if q[v, u]:
                                s += (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4 * q[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
                    out[b // part.stride * 8 + y, b % part.stride * 8 + x] = min(255, max(0, s + 128))
        planes.append(out)
    y, cb, cr = planes[0][:19, :37], *(p.repeat(2, 0).repeat(2, 1)[:19, :37] - 128 for p in planes[1:])
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1), 0, 255)
    assert np.abs(got - want).max() < 3


def test_payloads_come_back(spark):
    out = {}
    for r in media.media_table(documents(spark)).collect():
        out.setdefault(r.doc_id, r)
    for i, text, *_ in corpus():
        raw = (text or "").encode()
        full = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
    assert out[31].media_sha256 == out[32].media_sha256 == out[30].media_sha256
    assert out[0].feature == out[20].feature != out[1].feature


def test_any_bytes_come_back_in_any_batch():
    rng = random.Random(0)
    payloads = [bytes(rng.randrange(256) for _ in range(192 * n)) for n in (1, 2, 7, 40, 130, 700)] + [b"\xff" * 384, b"\x00" * 192]
    offs = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
    files = media.store_payloads(np.frombuffer(b"".join(payloads), np.uint8), offs)
    back, features = media.read_payloads(files)
    assert back == payloads
    alone = [media.read_payloads([f]) for f in files]
    assert [a[0][0] for a in alone] == payloads and [a[1][0] for a in alone] == features
    assert [media.store_payloads(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0] for p in payloads] == files


def test_tensor_column(spark):
    flat, offs, _ = media.padded(pa.array(["tensor"]))
    raw = media.store_payloads(flat, offs)[0]
    df = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.rgb_tensors(df).collect()}
    assert (got[1].height, got[1].width, len(got[1].rgb)) == (16, 16, 768) and got[2].rgb is None
    mean = np.frombuffer(got[1].rgb, np.uint8).reshape(-1, 3).astype(int).sum(0) * 1000 // 256 / 1000
    assert media.read_payloads([raw])[1] == ["16x16:" + ",".join(f"{x:.3f}" for x in mean)]


def test_damaged_files_are_flagged(spark):
    flat, offs, _ = media.padded(pa.array(["tensor"]))
    raw = media.store_payloads(flat, offs)[0]
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(raw[:40])), (3, bytearray(b""))], "doc_id long, media binary")
    got = {r.doc_id: (r.damaged, r.rgb is None) for r in media.rgb_tensors(df).collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (True, True)}


def test_damage_is_found():
    flat, offs, _ = media.padded(pa.array(["some text " * 100]))
    raw = media.store_payloads(flat, offs)[0]
    for bad in (b"", raw[:10], raw[:-2], raw.replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises(media.JpegError):
            media.read_payloads([bad])


def test_query_and_empty(spark):
    out = op2_progressive_jpeg(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in out:
        raw = texts[r.doc_id].encode()
        assert r.payload_sha256 == hashlib.sha256(raw + b" " * (-len(raw) % 192)).hexdigest()
    assert len(out) == len(texts)
    assert media.media_table(empty(spark)).count() == 0
