import hashlib
import struct

import pytest
import zstandard

from betwixt.llm import warc
from betwixt.llm.queries import op10_zstd_warc, oracle_sql

from ..util import same

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS payload", "'y' AS first", "3 AS salt").repartition(2)


LONG = "<p>long enough to be referred to</p>" * 5
ROWS = [(1, "http://a", LONG), (7, "http://b\r\nX: y", LONG), (3, None, LONG), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (8, "u", ""), (9, "é", "\r\n\r\nWARC/1.1\r\n" * 20), (1, "again", LONG), (None, "n", LONG), (10, "u", "é" * 50), (11, "u", "é" * 50), (12, "u", "x" * 300_000)]


def test_query_equals_its_oracle(spark):
    same(op10_zstd_warc, oracle_sql()["op10_zstd_warc"], spark)


def test_awkward_pages(spark):
    out = sorted((tuple(r) for r in warc.archive_table(pages(spark, ROWS)).collect()), key=str)

    def want(i, _, html):
        raw = (html or "").encode()
        same_ = [p for p, _, h in ROWS if h == html and p is not None]
        first = min(same_, default=None)
        revisit = len(raw) >= 100 and i is not None and i > first
        return (i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None)

    assert out == sorted((want(*r) for r in ROWS), key=str)
    assert warc.archive_table(pages(spark, ROWS).limit(0)).count() == 0


def test_layout_of_an_archive():
    records = [warc.make_record(i, f"http://x/{i}", (f"<html>{i} some words of a page</html>" * 20).encode(), "d", None) for i in range(60)]
    content = warc.pack(records)
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D and content[8 + size : 12 + size] == b"\x28\xb5\x2f\xfd"
    assert list(warc.unpack(content)) == records
    # a dictionary that is compressed itself
    body = zstandard.ZstdCompressor().compress(content[8 : 8 + size])
    assert list(warc.unpack(struct.pack("<II", magic, len(body)) + body + content[8 + size :])) == records
    few = warc.pack(records[:3])
    assert few[:4] == b"\x28\xb5\x2f\xfd" and list(warc.unpack(few)) == records[:3]
    assert list(warc.unpack(b"")) == []


def test_damage_is_found(spark):
    record = warc.make_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse_record(record)[1] == b"payload"
    for bad in (record[:-1], record + b"x", record.replace(b"WARC/1.1", b"HTTP/1.1"), record.replace(b"Content-Length: 7", b"Content-Length: 6"), record.replace(b"WARC-Date", b"WARC-Day"), record.replace(b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    content = warc.pack([record])
    with pytest.raises(warc.WarcError):
        list(warc.unpack(content[:-3]))
    wrong = warc.pack([record.replace(b"payload\r\n", b"PAYLOAD\r\n")])
    df = spark.createDataFrame([("a", bytearray(content)), ("b", bytearray(wrong)), ("c", bytearray(content[:-3]))], "path string, content binary")
    got = {r.path: r.error for r in warc.read_archives(df, "flag").collect()}
    assert got["a"] is None and "digest" in got["b"] and "short" in got["c"]
    with pytest.raises(Exception, match="WarcError"):
        warc.read_archives(df).collect()


def test_files(spark, tmp_path):
    archives = warc.write_archives(warc.assign_types(pages(spark, ROWS)))
    warc.export_archives(archives, f"file://{tmp_path}/out").collect()
    back = warc.read_archives(spark.read.format("binaryFile").load(f"{tmp_path}/out/*.warc.zst"))
    assert back.count() == len(ROWS)
