"""Operator 3: language by prediction by partial matching.

For each language a tree of byte contexts of order 0 to ``ORDER`` is counted on a bounded sample of
labelled texts and then frozen. A byte costs its code length in the longest context that the
language knows; each context that does not know the byte adds the code length of an escape
(escape method C: a context with ``t`` bytes of ``d`` kinds keeps ``d / (t + d)`` for escapes). The
language with the shortest code for the whole text is predicted; ``score`` is its share under
equal priors, from code lengths per byte.

All languages' trees are merged into one table of byte strings with one code length per language,
so a byte is priced by one lookup unless its context is new. The table is bounded by the sample.

Defined results: a text that is null or has no letter gets ``und`` and score 0. Ties go to the
first language by name. With no labelled text every row gets ``und``. Repeated rows each get
their row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import crc_fold, packed, slices

ORDER = 3
SAMPLE_DOCS = 150
SAMPLE_CHARS = 20_000
UNKNOWN = "und"
LETTER = r"\p{L}"


class _Table:
    """Row numbers of 32-bit keys by open addressing, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(math.ceil(math.log2(max(1, len(keys))))) + 2)
        self.shift = np.uint32(32 - bits)
        self.mask = np.uint32((1 << bits) - 1)
        self.rows = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros(1 << bits, np.uint32)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            slot = self._slot(keys[todo], step)
            free = self.rows[slot] < 0
            # Of several keys for one free slot the first takes it; the others go one further.
            _, winner = np.unique(slot[free], return_index=True)
            taken = np.flatnonzero(free)[winner]
            self.rows[slot[taken]] = todo[taken]
            self.keys[slot[taken]] = keys[todo[taken]]
            todo = np.delete(todo, taken)
            step += 1
        self.steps = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return (((keys * np.uint32(0x9E3779B1)) >> self.shift) + np.uint32(step)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = self._slot(keys, 0)
        rows = self.rows[slot]
        wrong = np.flatnonzero((self.keys[slot] != keys) & (rows >= 0))
        rows[self.keys[slot] != keys] = -1
        for step in range(1, self.steps):
            if not len(wrong):
                break
            slot = self._slot(keys[wrong], step)
            got, known = self.rows[slot], self.keys[slot] == keys[wrong]
            rows[wrong[known & (got >= 0)]] = got[known & (got >= 0)]
            wrong = wrong[~known & (got >= 0)]
        return rows


@dataclass
class ContextTrees:
    """Frozen statistics: for each order the known strings, their costs and escape costs.

    ``costs[k]`` prices the last byte of a known string of ``k + 1`` bytes after its first ``k``;
    ``escapes[k]`` prices leaving the context that is a known string of ``k`` bytes.
    """

    languages: list[str]
    strings: list[_Table]
    costs: list[np.ndarray]
    escapes: list[np.ndarray]


def _grams(data: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes that end at each index of ``ends`` as one number."""
    key = data[ends].astype(np.uint32)
    for back in range(1, size):
        key |= data[ends - back].astype(np.uint32) << np.uint32(8 * back)
    return key


def train(samples: dict[str, list[bytes]], order: int = ORDER) -> ContextTrees:
    """Count the context trees of each language and freeze their code lengths.

    A line break stands before every text, so a text's first bytes have a context too.
    """
    languages = sorted(samples)
    counted = []
    for language in languages:
        data = np.frombuffer(b"\n".join([b"", *samples[language], b""]), np.uint8)
        per = []
        for size in range(1, order + 2):
            ends = np.arange(size - 1, len(data))
            per.append(np.unique(_grams(data, ends, size), return_counts=True))
        counted.append(per)
    keys = [
        np.unique(np.concatenate([per[k][0] for per in counted])) if languages else
        np.zeros(0, np.uint32)
        for k in range(order + 1)
    ]
    costs = [np.zeros((len(k), len(languages)), np.float32) for k in keys]
    escapes = [np.zeros((1, len(languages)), np.float32)]
    escapes += [np.zeros((len(k), len(languages)), np.float32) for k in keys[:-1]]
    for column, per in enumerate(counted):
        for k in range(order + 1):
            own, counts = per[k]
            n = np.zeros(len(keys[k]))
            n[np.searchsorted(keys[k], own)] = counts
            # The context of a string is all but its last byte.
            if k == 0:
                parent, total, kinds = np.zeros(len(keys[0]), int), np.array([n.sum()]), np.array([(n > 0).sum()])
            else:
                parent = np.searchsorted(keys[k - 1], keys[k] >> np.uint32(8))
                total = np.bincount(parent, n, len(keys[k - 1]))
                kinds = np.bincount(parent, n > 0, len(keys[k - 1]))
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                hit = -np.log2(n / (total + kinds)[parent])
            escapes[k][:, column] = leave
            if k == 0:
                shorter = np.full(len(keys[0]), 8.0)
            else:
                suffix = keys[k] & np.uint32((1 << (8 * k)) - 1)
                shorter = costs[k - 1][np.searchsorted(keys[k - 1], suffix), column]
            costs[k][:, column] = np.where(n > 0, hit, leave[parent] + shorter)
    return ContextTrees(languages, [_Table(k) for k in keys], costs, escapes)


def code_lengths(trees: ContextTrees, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    rows, order = len(offsets) - 1, len(trees.costs) - 1
    # One line break before each text; order 3 looks back over it into filler zeros.
    spaced = np.zeros(len(data) + rows * (order + 1), np.uint8)
    begins = offsets[:-1] + (order + 1) * np.arange(1, rows + 1)
    sizes = np.diff(offsets)
    ends = np.arange(len(data)) + np.repeat((order + 1) * np.arange(1, rows + 1), sizes)
    spaced[ends] = data
    spaced[begins - 1] = 10
    price = np.zeros((len(ends), len(trees.languages)), np.float32)
    at = np.arange(len(ends))
    for k in range(order, -1, -1):
        if not len(at):
            break
        found = trees.strings[k].find(_grams(spaced, ends[at], k + 1))
        hit = found >= 0
        price[at[hit]] += trees.costs[k][found[hit]]
        at = at[~hit]
        if k:
            context = trees.strings[k - 1].find(_grams(spaced, ends[at] - 1, k))
            known = context >= 0
            price[at[known]] += trees.escapes[k][context[known]]
        else:
            price[at] += trees.escapes[0][0] + 8
    total = np.zeros((rows, len(trees.languages)))
    full = sizes > 0
    if full.any():
        total[full] = np.add.reduceat(price, offsets[:-1][full], axis=0, dtype=np.float64)
    return total


def _decide(trees: ContextTrees, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each row of a batch with ``text`` and ``has_letter``."""
    names = np.array([*trees.languages, UNKNOWN], dtype=object)
    letters = np.asarray(batch.column("has_letter").fill_null(False).cast(pa.uint8())) > 0
    best = np.full(batch.num_rows, len(trees.languages))
    score = np.zeros(batch.num_rows)
    if trees.languages:
        offsets, data = packed(batch.column("text"))
        bits = code_lengths(trees, offsets, data)
        best = np.where(letters, bits.argmin(axis=1), best)
        rate = bits / np.maximum(1, np.diff(offsets))[:, None]
        odds = np.exp2(rate.min(axis=1, keepdims=True) * 8 - rate * 8)
        score = np.where(letters, 1 / odds.sum(axis=1), 0.0)
    return names[best], score


def keep_known(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """The documents with a predicted language (those without a letter have none), all columns as they
    are. Whether a document stays does not depend on how many languages were learned."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 18):
            own = pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index("text")), batch.column(batch.num_columns - 1)],
                ["text", "has_letter"],
            )
            keep = _decide(shared.value, own)[0] != UNKNOWN
            rest = pa.RecordBatch.from_arrays(batch.columns[:-1], names=schema.names)
            yield rest.filter(pa.array(keep.astype(bool)))

    mark = "has_letter"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.col("text").rlike(LETTER))
    return marked.mapInArrow(run, schema)


def predict(docs: DataFrame, trees: ContextTrees, held: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    folds, fold = held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 18):
            lang, score = _decide(shared.value, batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(lang, pa.string()),
                    pa.array(score),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(
        "doc_id",
        "text",
        (crc_fold(folds) == fold).alias("held_out"),
        F.col("text").rlike(LETTER).alias("has_letter"),
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double"
    )


def labelled_texts(
    docs: DataFrame, held: tuple[int, int] = (4, 2), per_language: int = SAMPLE_DOCS
) -> dict[str, list[bytes]]:
    """At most ``per_language`` texts of each language, the first by a hash of their id.

    Only rows outside the held-out fold, with a language and a text of 1 to ``SAMPLE_CHARS``
    characters, take part. Ids are chosen before any text is moved. ``max_by`` on the hash keeps
    one row per (language, slot), so no language's rows meet in one task.
    """
    rows = docs.where(
        F.col("lang").isNotNull()
        & F.col("text").isNotNull()
        & (crc_fold(held[0]) != held[1])
        & F.length("text").between(1, SAMPLE_CHARS)
    )
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(per_language))
    rank = F.xxhash64(F.lit("rank"), "doc_id")
    picked = rows.groupBy("lang", slot.alias("slot")).agg(
        F.max_by("text", F.struct(rank, "text")).alias("text")
    )
    samples: dict[str, list[bytes]] = {}
    for r in picked.orderBy("lang", "slot").toLocalIterator():
        samples.setdefault(r["lang"], []).append(r["text"].encode("utf-8", "replace"))
    return samples


def language_predictions(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows outside fold 2 of 4 and predict for all documents."""
    return predict(docs, train(labelled_texts(docs)))
