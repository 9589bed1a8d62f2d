"""Operator 9: WARC archives, written with deduplicated, segmented records and read back.

Writing: a page becomes a ``response`` record (HTTP head and chunked body), or a ``revisit`` of the
record that holds an equal payload. A record whose block is longer than the segment size is cut:
the first part carries segment number 1, each ``continuation`` the id of the first and its own
number, the last also the total length. Chunks and segments end between characters, so archives
are text; they are written by Spark's text writer, gzipped, with the blank lines that end a
record as line separator, into shared storage.

Reading: each file is parsed by the content lengths of its records. Continuations are grouped by
the id of their origin, ordered by segment number, checked for gaps and against the total length,
and only then is the chunked framing undone. Revisits take their payload from the record that they
refer to. Groups are the segments of one record, never more; equal payloads meet as (digest, id)
rows in a join, so a payload that a third of the pages share is split by the join.

Defined results: null html is an empty payload; a null url an empty target. A row with a null
page_id is written and read back with a null id. Equal rows that share the largest page_id are
all responses. A record whose segments are incomplete or whose framing is broken is returned with
null bytes and digest. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.staging import new_path, stage

LEAST_SHARED = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
END = "\r\n\r\n"
HEAD = (
    "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
).encode()
DATE = "2024-01-01T00:00:00Z"


# --- framing -----------------------------------------------------------------------------------


def pieces(data: bytes, size: int) -> list[bytes]:
    """``data`` in parts of at most ``size`` bytes (3 less at worst) that end between characters."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(data[at:end])
        at = end
    return parts


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    framed = [b"%x\r\n%b\r\n" % (len(p), p) for p in pieces(payload, size)]
    return b"".join([*framed, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken or cut off."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    if b"transfer-encoding: chunked" in head.lower():
        return unchunked(body)
    return body


def record(fields: dict[str, str | None], block: bytes) -> str:
    """One record without the blank lines that end it."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields.items() if v is not None]]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines) + END + block.decode("utf-8")


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, repr(parts))}>"


def page_records(
    page_id: int | None,
    url: str | None,
    html: str | None,
    owner: int | None,
    own: str,
    segment: int = SEGMENT_BYTES,
) -> Iterator[str]:
    """The records of one page. ``own`` tells apart rows that are no one else's reference."""
    payload = (html or "").encode("utf-8")
    digest = hashlib.sha1(payload).hexdigest()
    shared = owner is not None
    fields = {
        "WARC-Target-URI": "".join((url or "").split()),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-Id": None if page_id is None else str(page_id),
    }
    if shared and page_id != owner:
        yield record(
            {
                "WARC-Type": "revisit",
                "WARC-Record-ID": _urn("revisit", digest, page_id, own),
                **fields,
                "WARC-Refers-To": _urn("page", digest, owner),
                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                "Content-Type": "application/http; msgtype=response",
            },
            HEAD,
        )
        return
    name = _urn("page", digest, page_id) if shared else _urn("page", digest, page_id, own)
    parts = pieces(HEAD + chunked(payload), segment)
    for number, part in enumerate(parts, 1):
        several = len(parts) > 1
        last = several and number == len(parts)
        yield record(
            {
                "WARC-Type": "response" if number == 1 else "continuation",
                "WARC-Record-ID": name if number == 1 else _urn(name, number),
                **(fields if number == 1 else {"WARC-Date": DATE}),
                "Content-Type": "application/http; msgtype=response" if number == 1 else None,
                "WARC-Segment-Number": str(number) if several else None,
                "WARC-Segment-Origin-ID": name if number > 1 else None,
                "WARC-Segment-Total-Length": str(sum(map(len, parts))) if last else None,
            },
            part,
        )


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.lower()] = value.strip()
        start = end + 4
        size = int(fields["content-length"])
        yield fields, data[start : start + size]
        at = start + size + 4


# --- tables --------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES) -> None:
    """Write the pages (page_id, url, html) as gzipped archives below ``path``."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("_digest"))
    owners = (
        rows.where(F.octet_length(html) >= LEAST_SHARED)
        .groupBy(F.col("_digest").alias("_key"))
        .agg(F.max("page_id").alias("_owner"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    owned = rows.join(owners, rows["_digest"] == owners["_key"], "left").select(
        "page_id", "url", "html", "_owner"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, size = [], 0
            columns = [batch.column(n) for n in ("page_id", "url", "html", "_owner")]
            for values in zip(*columns):
                page_id, url, text, owner = (v.as_py() for v in values)
                for made in page_records(page_id, url, text, owner, f"{task}-{number}", segment):
                    texts.append(made)
                    size += len(made)
                number += 1
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
                    texts, size = [], 0
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])

    owned.mapInArrow(run, "value string").write.option("lineSep", END).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", 5000).text(path)


RECORDS = (
    "record_id string, kind string, page_id bigint, digest string, refers_to string, "
    "number int, total bigint, block binary, payload_bytes bigint, payload_digest string"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; whole responses are decoded here, segments keep their block."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()),
                ("digest", pa.string()), ("refers_to", pa.string()), ("number", pa.int32()),
                ("total", pa.int64()), ("block", pa.binary()), ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
            ]
        )

        def row(fields: dict[str, str], block: bytes) -> dict:
            number = fields.get("warc-segment-number")
            payload = None
            if fields["warc-type"] == "response" and number is None:
                payload = payload_of(block)
            page = fields.get("x-page-id")
            total = fields.get("warc-segment-total-length")
            return {
                "record_id": fields.get("warc-segment-origin-id", fields["warc-record-id"]),
                "kind": fields["warc-type"],
                "page_id": None if page is None else int(page),
                "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
                "refers_to": fields.get("warc-refers-to"),
                "number": None if number is None else int(number),
                "total": None if total is None else int(total),
                "block": block if number is not None else None,
                "payload_bytes": None if payload is None else len(payload),
                "payload_digest": None if payload is None else hashlib.sha1(payload).hexdigest(),
            }

        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in parse(gzip.decompress(content.as_py())):
                    rows.append(row(fields, block))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("content").mapInArrow(run, RECORDS)


def _assemble(segments: list[tuple[int, int | None, bytes]]) -> tuple[int | None, str | None]:
    """Bytes and digest of the payload of a segmented record; nulls if it is not complete."""
    ordered = sorted(segments, key=lambda s: s[0])
    block = b"".join(s[2] for s in ordered)
    complete = [s[0] for s in ordered] == list(range(1, len(ordered) + 1))
    payload = payload_of(block) if complete and ordered[-1][1] == len(block) else None
    return (None, None) if payload is None else (len(payload), hashlib.sha1(payload).hexdigest())


def reassembled(records: DataFrame) -> DataFrame:
    """record_id, payload_bytes and payload_digest of the segmented records."""
    grouped = (
        records.where("number IS NOT NULL")
        .select("record_id", "number", "total", "block")
        .dropDuplicates(["record_id", "number"])
        .groupBy("record_id")
        .agg(F.collect_list(F.struct("number", "total", "block")).alias("segments"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for segments in batch.column("segments"):
                found = [(s["number"], s["total"], s["block"]) for s in segments.as_py()]
                size, digest = _assemble(found)
                sizes.append(size)
                digests.append(digest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("record_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                ["record_id", "payload_bytes", "payload_digest"],
            )

    return grouped.mapInArrow(
        run, "record_id string, payload_bytes bigint, payload_digest string"
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page record."""
    records = stage(read_records(spark, path), "warc-records")
    whole = reassembled(records)
    responses = records.where("kind = 'response'")
    direct = responses.where("number IS NULL").select(
        "record_id", "page_id", "payload_bytes", "payload_digest"
    )
    first = responses.where("number IS NOT NULL").select("record_id", "page_id")
    joined = first.join(whole, "record_id", "left").select(
        "record_id", "page_id", "payload_bytes", "payload_digest"
    )
    held = stage(direct.unionByName(joined), "warc-responses")
    origin = held.dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("_id"),
        F.col("page_id").alias("_page"),
        "payload_bytes",
        "payload_digest",
    )
    revisits = records.where("kind = 'revisit'").select("page_id", "refers_to")
    seen = revisits.join(origin, revisits["refers_to"] == origin["_id"], "left").select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.lit("revisit").alias("record_type"),
        F.col("_page").alias("refers_to"),
    )
    return held.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.lit("response").alias("record_type"),
        F.lit(None).cast("bigint").alias("refers_to"),
    ).unionByName(seen)


def round_trip(pages: DataFrame, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Write the pages to archives in shared storage and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, segment)
    return read_pages(pages.sparkSession, path)
