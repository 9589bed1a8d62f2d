"""Helpers of the operators: texts as numpy buffers, sample rows, sizes of partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of text that one numpy step works on, whatever the number of rows.
SLICE_BYTES = 4 << 20


def whole_text(name: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_fold(folds: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(
        F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)
    ).cast("int")


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows, starting at 0) and UTF-8 bytes of a text column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(
        column.type
    ) else pa.large_string()
    column = column.cast(large).fill_null(b"" if large == pa.large_binary() else "")
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = packed(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of a text column, counted by one aggregate; used for numbers of partitions alone."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    held: int,
    per_class: dict[int, int],
    max_chars: int,
) -> list[tuple[str, int]]:
    """Texts and labels to learn from: at most ``per_class`` rows of each class.

    Rows come from outside the held-out fold, have a non-null text of at most ``max_chars``
    characters, and are the first by a hash of their id, so the sample is the same in every run
    and its size has a bound. The texts of no other row leave their executor.
    """
    wanted = labels.where(
        F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(folds) != held)
    ).select("doc_id", F.col(label).cast("int").alias("y"))
    # Three times the number asked for, as some of the texts are too long or missing.
    ids = None
    for value, n in sorted(per_class.items()):
        part = wanted.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * n)
        ids = part if ids is None else ids.unionByName(part)
    short = docs.where(F.length("text") <= max_chars).select("doc_id", "text")
    joined = short.join(F.broadcast(ids.distinct()), "doc_id")
    rows = None
    for value, n in sorted(per_class.items()):
        part = joined.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(n)
        rows = part if rows is None else rows.unionByName(part)
    found = [(r["doc_id"], r["text"], r["y"]) for r in rows.toLocalIterator()]
    found.sort(key=lambda r: (r[0], r[2], r[1]))
    return [(text, y) for _, text, y in found]
