"""Operator 9: framing, parsing, reassembly and the round trip through shared storage."""

import hashlib

import duckdb
import pytest

from seriesloom.llm import warc
from seriesloom.llm.oracle import ORACLE_SQL
from tests.llm.helpers import rows_of

SCHEMA = "page_id bigint, url string, html string"


@pytest.mark.parametrize("size", [1, 3, 7, 4096])
def test_chunks_round_trip(size):
    for payload in (b"", b"a", "größe – 日本語 👩‍👩‍👧".encode() * 5, b"\r\n0\r\n\r\n" * 3):
        assert warc.unchunked(warc.chunked(payload, size)) == payload
        assert b"".join(warc.pieces(payload, size)) == payload


def test_broken_framing_is_null():
    for body in (b"", b"5\r\nab", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        assert warc.unchunked(body) is None


def test_segments_are_checked():
    block = warc.HEAD + warc.chunked(b"hello world")
    parts = [(3, len(block), block[20:]), (1, None, block[:10]), (2, None, block[10:20])]
    assert warc._assemble(parts) == (11, hashlib.sha1(b"hello world").hexdigest())
    assert warc._assemble(parts[:2]) == (None, None)
    assert warc._assemble([(3, len(block) + 1, block[20:]), *parts[1:]]) == (None, None)


def test_records_parse_back():
    html = "<p>ä\r\n\r\nWARC/1.1\r\n</p>" * 400
    text = "\r\n\r\n".join(warc.page_records(7, "http://a b", html, None, "x", 1000)) + "\r\n\r\n"
    found = list(warc.parse(text.encode()))
    assert [f["warc-type"] for f, _ in found] == ["response"] + ["continuation"] * (len(found) - 1)
    assert warc.payload_of(b"".join(b for _, b in found)) == html.encode()


def test_round_trip_equals_sql(spark, sample):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    copies = pages.selectExpr("page_id + 1000 AS page_id", "url", "html").limit(20)
    long = spark.createDataFrame([(5000, "u", "é" * 60_000), (5001, None, "é" * 60_000)], SCHEMA)
    small = spark.createDataFrame([(6000, "u", "x"), (6001, "u", "x"), (6002, "u", None), (6003, "u", "")], SCHEMA)
    table = pages.unionByName(copies).unionByName(long).unionByName(small)
    frame = table.toPandas()
    database = duckdb.connect()
    database.register("pages", frame)
    want = database.sql(ORACLE_SQL["op9_warc"]).fetchall()
    assert sorted(rows_of(warc.round_trip(table))) == sorted(want)


def test_archives_awkward(spark):
    big = "y" * 40_000
    rows = [(1, "u", big), (2, None, big), (2, "u\r\nx", big), (None, "u", big), (None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS number", "2 AS kind")
    digest, none = hashlib.sha1(big.encode()).hexdigest(), hashlib.sha1(b"").hexdigest()
    want = [
        (1, 40_000, digest, "revisit", 2), (2, 40_000, digest, "response", None),
        (2, 40_000, digest, "response", None), (None, 40_000, digest, "revisit", 2),
        (None, 0, none, "response", None),
    ]
    assert sorted(rows_of(warc.round_trip(table)), key=str) == sorted(want, key=str)
    assert warc.round_trip(table.limit(0)).count() == 0
