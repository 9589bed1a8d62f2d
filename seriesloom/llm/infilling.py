"""Operator 12: fill-in-middle transformation, cut at places of a compressed boundary set.

A text is cut into units that end after a line feed (or at its end). The byte offsets where units
end form a set of integers in the manner of a Roaring bitmap: offsets with the same high bits
share a container, which is a sorted array, a bitmap or a list of runs, whichever is smallest;
cumulative cardinalities of the containers say in which one the k-th boundary lies, and a select
inside that container gives its offset. Both cut offsets of a document are found so. Four numbers
of a hash of the document's id choose the cuts and the form, so a rerun gives the same output.

A text is handled by one task as bytes; the set has at most two bytes a boundary and no more than
8 KB per 64 KB of text. Nothing is shuffled.

Defined results: a null or empty text, and one that holds a sentinel, keeps its text as ``plain``
with null lengths. A null id hashes as the empty text. Repeated rows each get their row; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import packed, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LOW_BITS = 16
_ARRAY, _BITMAP, _RUNS = range(3)


def _container(low: np.ndarray) -> tuple[int, tuple[np.ndarray, ...]]:
    """The smallest form of a sorted set of 16-bit values."""
    breaks = np.flatnonzero(np.diff(low) != 1) + 1
    n_runs = len(breaks) + 1
    if 4 * n_runs < min(2 * len(low), 8192):
        first = np.concatenate([[0], breaks])
        return _RUNS, (low[first].astype(np.uint16), first)
    if 2 * len(low) <= 8192:
        return _ARRAY, (low.astype(np.uint16),)
    words = np.zeros(1024, np.uint64)
    np.bitwise_or.at(words, low >> 6, np.uint64(1) << (low & 63).astype(np.uint64))
    return _BITMAP, (words, np.cumsum(np.bitwise_count(words), dtype=np.int64))


@dataclass
class BoundarySet:
    """A set of offsets: keys (high bits), cumulative cardinalities, and containers."""

    keys: np.ndarray
    upto: np.ndarray  # members in this container and all before it
    containers: list[tuple[int, tuple[np.ndarray, ...]]]

    @classmethod
    def of(cls, offsets: np.ndarray) -> BoundarySet:
        """From strictly ascending offsets."""
        high = offsets >> LOW_BITS
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        ends = np.append(starts[1:], len(offsets)).astype(np.int64)
        low = offsets & ((1 << LOW_BITS) - 1)
        return cls(high[starts], ends, [_container(low[a:b]) for a, b in zip(starts, ends)])

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The k-th smallest member, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.upto, k, side="right"))
        rest = k - (int(self.upto[at - 1]) if at else 0)
        kind, parts = self.containers[at]
        if kind == _ARRAY:
            low = int(parts[0][rest])
        elif kind == _RUNS:
            run = int(np.searchsorted(parts[1], rest, side="right")) - 1
            low = int(parts[0][run]) + rest - int(parts[1][run])
        else:
            word = int(np.searchsorted(parts[1], rest, side="right"))
            rest -= int(parts[1][word - 1]) if word else 0
            bits = np.unpackbits(parts[0][word : word + 1].view(np.uint8), bitorder="little")
            low = (word << 6) + int(np.flatnonzero(bits)[rest])
        return (int(self.keys[at]) << LOW_BITS) + low


def boundaries(raw: np.ndarray) -> BoundarySet:
    """Byte offsets where the units of a UTF-8 text end."""
    ends = np.flatnonzero(raw == 10) + 1
    if len(raw) and (not len(ends) or ends[-1] != len(raw)):
        ends = np.append(ends, len(raw))
    return BoundarySet.of(ends.astype(np.int64))


def choices(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2**32 for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def _characters(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


@dataclass(frozen=True)
class Settings:
    """Shares are in hundredths: documents transformed, and of these those with the suffix first."""

    seed: int = 7
    transformed: int = 100
    suffix_first: int = 50


def transform(raw: np.ndarray, doc_id: int | None, settings: Settings = Settings()):
    """(units, form, prefix characters, middle characters, output bytes) of one text."""
    units = boundaries(raw)
    n, text = len(units), raw.tobytes()
    h1, h2, h3, h4 = choices(doc_id, settings.seed)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not text or h3 % 100 >= settings.transformed or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = (0 if k == 0 else units.select(k - 1) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    before, between, after = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h4 % 100 < settings.suffix_first:
        form, output = "spm", b"".join((s, after, p, before, m, between))
    else:
        form, output = "psm", b"".join((p, before, s, after, m, between))
    return n, form, _characters(raw[:a]), _characters(raw[a:b]), output


def transformed(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output (text) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            offsets, raw = packed(batch.column("text"))
            ids = batch.column("doc_id")
            rows = [
                transform(raw[a:b], i, settings)
                for a, b, i in zip(offsets[:-1], offsets[1:], ids.to_pylist())
            ]
            n, form, prefix, middle, output = zip(*rows)
            columns = [
                pa.array(n, pa.int64()),
                pa.array(form, pa.string()),
                pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()),
                pa.array(output, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(
                [ids, *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string",
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by its marks.

    A text with a mark inside is plain, and no mark can arise where a part meets a mark, so the
    first place of each mark is its own.
    """
    p, s, m = (F.locate(mark, output) for mark in (PREFIX, SUFFIX, MIDDLE))
    size = F.lit(3)

    def between(first: Column, second: Column) -> Column:
        return F.substring(output, first + size, second - first - size)

    middle = F.substring(output, m + size, F.length(output))
    return (
        F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
        .when(form == "spm", F.concat(between(p, m), middle, between(s, p)))
        .otherwise(output)
    )


def digests(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The transformation of every document with hashes of its output and of the restored text."""
    made = transformed(docs, settings)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
