"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Layout of an archive: a skippable frame (magic 0x184D2A5D) with the dictionary, then one Zstandard frame for
each WARC/1.1 record, compressed with that dictionary. An archive whose records are too few to train a
dictionary has no leading frame; the reader takes both.

``write_archives`` groups records in archives of about ``archive_bytes`` of content, so that neither a task nor
a row holds more than that (or one larger record). Archives are rows (path, content), the shape that Spark's
``binaryFile`` source has, so ``read_archives`` also reads real files. Between writer and reader they are kept as
Parquet in the shared folder, since on a cluster no local folder is shared; ``export_archives`` writes files.

The reader checks each record: version line, mandatory headers, one record in a frame, Content-Length against
the block, the closing CRLFs, and the SHA-256 of a response's payload. A bad archive raises ``WarcError``, or
yields a row with ``error`` set when ``on_error='flag'``.

Records with equal payloads of at least ``least_bytes`` bytes: the smallest page_id is a response, the others
revisit it. Defined results: a null html is an empty payload; pages that repeat the smallest page_id of a payload
are responses too (they are the same record); null page_ids never are referred to and never revisit; a null url
is written as urn:null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

DICT_MAGIC = 0x184D2A5D
CRLF = b"\r\n"
DATE = b"2024-01-01T00:00:00Z"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
ARCHIVE_BYTES = 8 << 20
DICT_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20


class WarcError(ValueError):
    pass


def record_id(page_id: int | None) -> bytes:
    return b"<urn:uuid:" + str(uuid.uuid5(SPACE, f"page:{page_id}")).encode() + b">"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit (``refers_to`` set) without one."""
    clean = " ".join((url or "urn:null").split()) or "urn:null"
    kind = b"response" if refers_to is None else b"revisit"
    block = payload if refers_to is None else b""
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind,
        b"WARC-Record-ID: " + record_id(page_id),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + clean.encode("utf-8", "surrogatepass"),
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"X-Page-ID: " + (b"" if page_id is None else str(page_id).encode()),
        b"X-Payload-Length: " + str(len(payload)).encode(),
    ]
    if refers_to is not None:
        head += [b"WARC-Refers-To: " + record_id(refers_to), b"X-Refers-To-Page: " + str(refers_to).encode(), b"WARC-Profile: " + PROFILE]
    head += [b"Content-Type: text/html", b"Content-Length: " + str(len(block)).encode()]
    return CRLF.join(head) + CRLF + CRLF + block + CRLF + CRLF


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of exactly one record."""
    at = raw.find(CRLF + CRLF)
    if at < 0:
        raise WarcError("no end of headers")
    lines = raw[:at].split(CRLF)
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no version line")
    head: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError("a header without a name")
        head[name.decode("ascii", "replace").lower()] = value.decode("utf-8", "replace").strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise WarcError(f"no {name}")
    if not head["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    n = int(head["content-length"])
    block = raw[at + 4 : at + 4 + n]
    if len(block) != n or raw[at + 4 + n :] != CRLF + CRLF:
        raise WarcError("Content-Length differs from the block, or more than a record in a frame")
    return head, block


def train(records: list[bytes], size: int = DICT_BYTES, sample_bytes: int = SAMPLE_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from the archive's records, spread evenly, up to ``sample_bytes``; None if they are too few."""
    total = sum(map(len, records))
    step = max(1, total // sample_bytes)
    samples = [r[: 16 << 10] for r in records[::step]]
    if len(samples) < 16 or sum(map(len, samples)) < 16 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, k=512, d=8)
    except zstandard.ZstdError:
        return None


def pack(records: list[bytes], level: int = 3) -> bytes:
    """The archive of these records."""
    known = train(records)
    out = []
    if known is not None:
        body = known.as_bytes()
        out += [struct.pack("<II", DICT_MAGIC, len(body)), body]
        press = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
    else:
        press = zstandard.ZstdCompressor(level=level, write_checksum=True)
    out += [press.compress(r) for r in records]
    return b"".join(out)


def unpack(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one for each frame."""
    view, at, known = memoryview(content), 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", content, 4)[0]
        if 8 + size > len(content):
            raise WarcError("the dictionary's frame is cut short")
        body = bytes(view[8 : 8 + size])
        if body[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
            body = zstandard.ZstdDecompressor().decompress(body)
        known, at = zstandard.ZstdCompressionDict(body), 8 + size
    press = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    piece = 16 << 10
    while at < len(content):
        frame, parts = press.decompressobj(), []
        while not frame.eof:
            if at >= len(content):
                raise WarcError("the last frame is cut short")
            feed = view[at : at + piece]
            try:
                parts.append(frame.decompress(feed))
            except zstandard.ZstdError as e:
                raise WarcError(f"bad frame: {e}") from e
            at += len(feed) - (len(frame.unused_data) if frame.eof else 0)
        yield b"".join(parts)


def assign_types(pages: DataFrame, least_bytes: int = 100, salts: int = 32) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to: the page to refer to, or null for a response.

    Only digests of more than one page are joined back. A hot payload may be a third of all pages, so that side
    of the join is spread over ``salts`` parts and the (small) other side repeated in each.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("payload_digest", F.sha2("payload", 256))
    many = (
        base.filter((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull())
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .filter(F.col("last") > F.col("first"))
        .select(F.col("payload_digest").alias("d"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    )
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = salted.join(many, (F.col("payload_digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    return joined.select(
        "page_id", "url", "payload", "payload_digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to")
    )


def write_archives(typed: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(path, content) of the archives that hold all rows of ``typed`` (see ``assign_types``)."""
    bounded_batches(typed.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def archive() -> pa.RecordBatch:
            content = pack(held)
            name = f"{hashlib.sha256(content).hexdigest()[:24]}.warc.zst"
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["path", "content"])

        for b in batches:
            for row in zip(*b.columns, strict=True):
                page_id, url, payload, digest, refers = (x.as_py() for x in row)
                held.append(make_record(page_id, url, payload, digest, refers))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    size = 0
        if held:
            yield archive()

    return typed.mapInArrow(write, "path string, content binary")


def read_archives(archives: DataFrame, on_error: str = "raise") -> DataFrame:
    """A row for each record of (path, content), as the archives hold it."""
    names = ["path", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "error"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def number(x: str | None) -> int | None:
        return int(x) if x else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                path, rows = path.as_py(), []
                try:
                    for raw in unpack(content.as_py()):
                        head, block = parse_record(raw)
                        kind, digest = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha256:")
                        size = int(head.get("x-payload-length", len(block)))
                        if kind == "response" and (hashlib.sha256(block).hexdigest() != digest or size != len(block)):
                            raise WarcError("the payload differs from its digest or length")
                        if kind == "revisit" and "warc-refers-to" not in head:
                            raise WarcError("a revisit without WARC-Refers-To")
                        rows.append((path, number(head.get("x-page-id")), size, digest, kind, number(head.get("x-refers-to-page")), head.get("warc-target-uri"), None))
                except WarcError as e:
                    if on_error == "raise":
                        raise WarcError(f"{path}: {e}") from e
                    rows.append((path, None, None, None, None, None, None, str(e)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    schema = "path string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, error string"
    bounded_batches(archives.sparkSession)  # by bytes, so a batch has few archives
    return archives.select("path", "content").mapInArrow(read, schema)


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write the archives as files of a folder that executors can open; returns (path, bytes)."""
    from pyarrow import fs

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = fs.FileSystem.from_uri(folder)
        at.create_dir(base, recursive=True)
        for b in batches:
            sizes = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with at.open_output_stream(f"{base}/{path}", compression=None) as out:  # the content is compressed already
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(sizes, np.int64))], ["path", "bytes"])

    return archives.select("path", "content").mapInArrow(save, "path string, bytes long")


def archive_table(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Write all pages, read the archives back, and return what they say of each page."""
    archives = materialize(write_archives(assign_types(pages, least_bytes)), "warc")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(encode(coalesce(html, ''))) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f"""
