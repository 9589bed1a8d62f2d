"""Operator 7: near-duplicates by SimHash and covering locality-sensitive hashing.

The fingerprint has one bit per bit of the shingle hashes, set if over half of them have it. The
hash (XXH64) is computed for all shingles of a batch at once, by groups of equal length.

Pairs within ``RADIUS`` bits are found by a covering family: each bit position gets a vector of
``RADIUS + 1`` bits other than zero; table ``v`` keeps the positions whose vector has an odd inner
product with ``v``. Any ``RADIUS`` positions leave some ``v`` orthogonal to all their vectors, so
two fingerprints that differ in at most ``RADIUS`` places are equal in that table. With 31 tables
for radius 4 no pair is missed; each table compares 32 bits, one all 64.

Scale: documents collapse to distinct fingerprints first, so copies cost nothing further. A
bucket is linked inside one task, by exact comparison; buckets emit a spanning forest, never all
pairs. Components then come from label propagation on those links, in shared storage.

Defined results: null and empty texts, and those without a word, have fingerprint zero and are
linked like any other. A text of fewer words than a shingle has one shingle, all its words.
Repeated rows share a component. Rows with a null id get their row and null as component unless a
row with an id is linked to them; ids are compared as numbers. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import packed, slices
from seriesloom.llm.components import component_labels
from seriesloom.staging import stage

WORDS = 4
RADIUS = 4
SEED = 42

# The five primes of XXH64.
_P = [
    np.uint64(11400714785074694791),
    np.uint64(14029467366897019727),
    np.uint64(1609587929392839161),
    np.uint64(9650029242287828579),
    np.uint64(2870177450012600261),
]


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(lane: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _turn(lane + word * _P[1], 31) * _P[0]


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span ``data[start : start + size]``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    longs = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    ints = np.ndarray((len(data) + 1,), "<u4", padded, 0, (1,))
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    edges = np.flatnonzero(np.diff(ordered, prepend=-1, append=-1))
    full = (1 << 64) - 1
    p0, p1, p4 = int(_P[0]), int(_P[1]), int(_P[4])
    first = [np.uint64(x & full) for x in (seed + p0 + p1, seed + p1, seed, seed - p0)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        rows, size = order[lo:hi], int(ordered[lo])
        at, end = starts[rows].copy(), starts[rows] + size
        left = size
        if size >= 32:
            lanes = [np.full(len(rows), x) for x in first]
            while left >= 32:
                for k in range(4):
                    lanes[k] = _round(lanes[k], longs[at + 8 * k])
                at += 32
                left -= 32
            h = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for k in range(4):
                h = (h ^ _round(np.zeros(1, np.uint64), lanes[k])) * _P[0] + _P[3]
        else:
            h = np.full(len(rows), np.uint64((seed + p4) & full))
        h += np.uint64(size)
        while left >= 8:
            h = _turn(h ^ _round(np.zeros(1, np.uint64), longs[at]), 27) * _P[0] + _P[3]
            at += 8
            left -= 8
        if left >= 4:
            h = _turn(h ^ (ints[at].astype(np.uint64) * _P[0]), 23) * _P[1] + _P[2]
            at += 4
            left -= 4
        while left > 0:
            h = _turn(h ^ (padded[at].astype(np.uint64) * _P[4]), 11) * _P[0]
            at += 1
            left -= 1
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
        out[rows] = h ^ (h >> np.uint64(32))
    return out


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, ...]:
    """Normalised bytes of all texts, start and size of each shingle, shingles per text."""
    clean = [b" ".join(t.lower().split()) for t in texts]
    data = np.frombuffer(b" ".join(clean), np.uint8)
    lengths = np.array([len(c) for c in clean], np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    gaps = np.flatnonzero(data == 32)
    # The space after each text is a gap too; words of a text are the pieces between its gaps.
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(data)]])
    full = lengths > 0
    first = np.searchsorted(starts, begin)
    number = np.where(full, np.searchsorted(ends, begin + lengths, side="right") - first, 0)
    count = np.where(full, np.maximum(number - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    head = first[owner] + step
    tail = head + np.minimum(words, number[owner]) - 1
    return data, starts[head], ends[tail] - starts[head], count


def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """64-bit fingerprint of each text; zero without words."""
    data, starts, sizes, count = shingles(texts, words)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(count > 0)
    if not len(full):
        return out
    hashes = xxh64(data, starts, sizes).astype("<u8")
    first = (np.cumsum(count) - count)[full]
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    major = (2 * sums > count[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def covering_masks(radius: int = RADIUS, bits: int = 64) -> np.ndarray:
    """One mask per table: every set of ``radius`` positions is outside some mask."""
    # A leading one, then counting: every v finds half of them odd, or all.
    vectors = [(1 << radius) + k % (1 << radius) for k in range(bits)]
    masks = []
    for v in range(1, 1 << (radius + 1)):
        masks.append(sum(1 << k for k, m in enumerate(vectors) if (m & v).bit_count() & 1))
    return np.array(masks, np.uint64)


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (index pairs) that span each component of distinct values within ``radius``.

    A value is compared with those that no component has yet, once: a dense group is one component
    after its first value, and only values without neighbours are compared with all others.
    """
    unseen, links = np.arange(len(values)), []
    while len(unseen) > 1:
        waiting, unseen = [int(unseen[0])], unseen[1:]
        while waiting and len(unseen):
            at = waiting.pop()
            near = np.bitwise_count(values[unseen] ^ values[at]) <= radius
            if near.any():
                found = unseen[near].tolist()
                unseen = unseen[~near]
                links += [(at, other) for other in found]
                waiting += found
    return links


def fingerprint_table(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (as bigint) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 19):
            offsets, data = packed(batch.column("text"))
            view = data.tobytes()
            texts = [view[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            values = fingerprints(texts, words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values)], ["doc_id", "fp"]
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fp bigint")


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of the buckets of one partition; rows come sorted by (table, bucket)."""
    held_key, held = None, []

    def emit(values: list[int]) -> list[tuple[int, int]]:
        fps = np.unique(np.array(values, np.int64)).view(np.uint64)
        return [(int(fps[a].view(np.int64)), int(fps[b].view(np.int64))) for a, b in forest(fps, radius)]

    def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        tables = np.asarray(batch.column("tab"))
        buckets = np.asarray(batch.column("bucket"))
        fps = np.asarray(batch.column("fp"))
        change = np.flatnonzero((np.diff(tables) != 0) | (np.diff(buckets) != 0)) + 1
        edges = np.concatenate([[0], change, [len(fps)]])
        links: list[tuple[int, int]] = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            key = (tables[lo], buckets[lo])
            if key != held_key:
                if len(held) > 1:
                    links += emit(held)
                held_key, held = key, []
            held.extend(fps[lo:hi].tolist())
        if links:
            yield batch_of(links)
    if len(held) > 1:
        yield batch_of(emit(held))


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span the components within ``radius``."""
    masks = covering_masks(radius).view(np.int64)
    tables = F.array(
        *[
            F.struct(F.lit(k).alias("tab"), F.col("fp").bitwiseAND(F.lit(int(m))).alias("bucket"))
            for k, m in enumerate(masks)
        ]
    )
    keyed = distinct.select("fp", F.explode(tables).alias("t")).select("fp", "t.tab", "t.bucket")
    near = keyed.repartition("tab", "bucket").sortWithinPartitions("tab", "bucket")
    return near.mapInArrow(lambda batches: _bucket_links(batches, radius), "a bigint, b bigint")


def components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = stage(fingerprint_table(docs, words), "simhash-prints")
    distinct = stage(
        prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct"
    )
    labels = component_labels(distinct, "fp", "first", fingerprint_links(distinct.select("fp"), radius))
    return prints.join(labels, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("label").alias("component_id"),
    )
