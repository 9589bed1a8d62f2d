"""Operator 1: quality classifier by supervised subword embeddings.

Every word, every character n-gram within a word (with one boundary on each side) and every pair
of words is hashed to a row of an embedding table; all pairs of a word with itself share one row. A document is the mean of its rows; a softmax layer on the mean
gives the classes. Table and layer are learned together by stochastic gradient descent in numpy.

Scoring uses that the output layer is linear: the mean of rows times the layer equals the mean of
(rows times the layer), so each hash bucket needs one number per class. That product is what the
tasks receive; its size is fixed by the number of buckets.

Defined results: a null text counts as empty; an empty text has no feature and gets the share
of the classes that the bias stands for. Repeated rows each get their row. Other columns of the
input are left alone and not read. No labelled row: the score is 0.5 everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import crc_fold, labelled_sample, packed, slices

BUCKET_BITS = 16
GRAMS = (3, 4)
DIMENSIONS = 6
SAMPLE_PER_CLASS = {0: 1200, 1: 2000}
SAMPLE_CHARS = 60_000
LEAST_STEPS = 600

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def features(
    offsets: np.ndarray, data: np.ndarray, bits: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, mask, position of each row's first element): one triple per kind of feature.

    The texts are laid out as code points, one line break before, between and after them.
    """
    raw = bytearray()
    view = data.tobytes()
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        raw += b"\n"
        raw += view[start:stop]
    raw += b"\n"
    points = np.frombuffer(bytes(raw).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    counts = np.concatenate([[0], np.cumsum(heads)])
    first = counts[offsets[:-1] + np.arange(len(offsets) - 1)]  # the line break before each text
    space = (points == 32) | ((points >= 9) & (points <= 13))
    points = np.where(space, np.uint32(32), points)
    n = len(points)

    begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    powers = np.multiply.accumulate(np.full(n + 1, _BASE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * powers[:n], dtype=np.uint64)])
    back = np.multiply.accumulate(np.full(n + 1, _INVERSE, np.uint64))
    word = (sums[ends] - sums[begins]) * back[begins]
    folded = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    codes = _bucket((folded >> np.uint64(32)).astype(np.uint32), bits)
    whole = np.ones(len(begins), bool)
    place = np.searchsorted(begins, first + 1)
    yield codes, whole, place
    if len(codes):
        same = np.zeros(len(codes), bool)
        same[1:] = word[1:] == word[:-1]
        follows = whole.copy()
        follows[place[place < len(codes)]] = False  # a row's first word has no word before it
        previous = np.concatenate([codes[:1], codes[:-1]])
        pairs = _bucket((codes * _ODD[0]) ^ (previous * _ODD[1]), bits)
        yield np.where(same, np.uint32(0), pairs), follows, place
    inner = ~space
    inner = inner[1:-1]
    for size in GRAMS:
        m = n - size + 1
        if m <= 0:
            continue
        h = points[:m] * _ODD[0]
        for k in range(1, size):
            h ^= points[k : k + m] * _ODD[k]
            h *= np.uint32(0x01000193)
        h ^= np.uint32(size)
        # The characters between the two ends are no white space, so a gram never spans two rows;
        # it belongs to the row whose line break stands at or before its first character.
        inside = inner[:m]
        for k in range(1, size - 2):
            inside = inside & inner[k : k + m]
        yield _bucket(h, bits), inside, np.minimum(first, m)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` from each start up to the next; 0 where nothing lies between."""
    # The zero at the end stands for rows that start behind the last value.
    total = np.add.reduceat(np.append(values, values.dtype.type(0)), first, dtype=np.float64)
    return np.where(np.diff(np.append(first, len(values))) > 0, total, 0.0)


@dataclass
class SubwordModel:
    """Embedding table, softmax layer and bias."""

    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    bits: int = BUCKET_BITS

    def folded(self) -> np.ndarray:
        """Per bucket, what it adds to each class before the mean."""
        return np.ascontiguousarray((self.table @ self.layer).T.astype(np.float32))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bags(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their shares of the mean."""
    bags = []
    for text in texts:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        found = [b[m] for b, m, _ in features(np.array([0, len(data)]), data, bits)]
        buckets, counts = np.unique(np.concatenate(found), return_counts=True)
        bags.append((buckets, (counts / max(1, counts.sum())).astype(np.float32)))
    return bags


def fit(
    sample: list[tuple[str, int]],
    classes: int = 2,
    bits: int = BUCKET_BITS,
    dimensions: int = DIMENSIONS,
    epochs: int = 6,
    rate: float = 40.0,
    batch: int = 32,
    seed: int = 7,
) -> SubwordModel:
    """Learn from (text, class) pairs by stochastic gradient descent.

    A small sample is gone through more often than ``epochs``, so that it takes ``LEAST_STEPS`` steps.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / dimensions, (1 << bits, dimensions)).astype(np.float32)
    layer = rng.normal(0, 0.5, (dimensions, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    if not sample:
        return SubwordModel(table, layer * 0, bias, bits)
    y = np.array([c for _, c in sample])
    bags = _bags([t for t, _ in sample], bits)
    each = -(-len(bags) // batch)
    epochs = max(epochs, min(80, -(-LEAST_STEPS // each)))
    steps, done = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            step = rate * (1 - done / steps)
            done += 1
            sizes = np.array([len(bags[r][0]) for r in rows])
            buckets = np.concatenate([bags[r][0] for r in rows])
            shares = np.concatenate([bags[r][1] for r in rows])
            owner = np.repeat(np.arange(len(rows)), sizes)
            values = table[buckets] * shares[:, None]
            means = np.stack(
                [np.bincount(owner, values[:, k], len(rows)) for k in range(dimensions)], 1
            )
            error = _softmax(means @ layer + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            error /= len(rows)
            pull = error @ layer.T
            used, place = np.unique(buckets, return_inverse=True)
            for k in range(dimensions):
                table[used, k] -= step * np.bincount(place, shares * pull[owner, k], len(used))
            layer -= 0.02 * step * (means.T @ error).astype(np.float32)
            bias -= 0.02 * step * error.sum(0).astype(np.float32)
    return SubwordModel(table, layer, bias, bits)


def probabilities(
    offsets: np.ndarray, data: np.ndarray, folded: np.ndarray, bias: np.ndarray, bits: int
) -> np.ndarray:
    """Class probabilities of each text."""
    rows, classes = len(offsets) - 1, folded.shape[0]
    total, number = np.zeros((rows, classes)), np.zeros(rows)
    for buckets, mask, first in features(offsets, data, bits):
        number += _sums(mask, first)
        for c in range(classes):
            total[:, c] += _sums(folded[c][buckets] * mask, first)
    return _softmax(total / np.maximum(number, 1)[:, None] + bias)


def score(docs: DataFrame, model: SubwordModel, held_folds: int = 5) -> DataFrame:
    """doc_id, held_out, score (probability of class 1) and predicted for every whole text."""
    folded, bias, bits = model.folded(), model.bias, model.bits
    shared = docs.sparkSession.sparkContext.broadcast((folded, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded, bias = shared.value
        for batch in slices(batches, size=1 << 18):
            offsets, data = packed(batch.column("text"))
            p = probabilities(offsets, data, folded, bias, bits)[:, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(p),
                    pa.array((p >= 0.3).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", "text", (crc_fold(held_folds) == 0).alias("held_out"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {id_type}, held_out boolean, score double, predicted int"
    )


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows outside fold 0 and score all documents."""
    sample = labelled_sample(docs, labels, "quality", 5, 0, SAMPLE_PER_CLASS, SAMPLE_CHARS)
    return score(docs, fit(sample))
