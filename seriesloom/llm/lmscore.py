"""Operator 13: scores by a bigram model of the corpus, held as Elias-Fano tries in shards.

Tokens are words (A-Z in lower case) and one end per text, which is also what stands before its first
word. A word's unigram probability is (c + 1) / (N + V + 1); after another it is interpolated,
(c(v, w) + MASS * p(w)) / (c(v) + MASS): every context's probabilities sum to one, and a context that
was never seen gives the unigram. The tries hold the quantised first part, c(v, w) / (c(v) + MASS).

Nothing the size of the corpus is in one place. Documents form blocks of up to ``BLOCK_BYTES`` of text;
a block sends its different words, by hash, to shards that count them, number them by frequency
and answer with number and count; then its different pairs, by hash of the first word (of both, when
the first occurs over ``HOT`` times), to shards that add them up, build their trie, map it, and answer
with the probability of each pair. Both numbers of shards follow the words and tokens counted, so a
shard stays about equal in size at any scale; of one word or pair it gets one entry a block.

Probabilities are exact but for the quantisation (a relative error below 0.03 %) of the first part.

Defined results: a null or empty text is its end alone. Without training texts every probability is
that of the unigram. A null id falls into the fold of the empty text. Repeated rows are repeated
texts; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import crc_fold, slices, whole_text
from seriesloom.llm.triemodel import MISSING, Trie, dequantised, quantised
from seriesloom.staging import stage

BLOCK_BYTES = 16 << 20
# Bytes of one text that are split at a time.
STRETCH = 4 << 20
WORDS_PER_SHARD = 400_000
TOKENS_PER_SHARD = 2_000_000
HOT = 100_000
MASS = 80.0
END = 0  # number of the end; words are numbered from 1

_LOWER = bytes(range(256)).lower()
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


# --- numbers as bytes ---------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on, their bytes by significance, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(body: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), np.uint8)
    values = np.zeros((len(raw) // body[0], 8), np.uint8)
    values[:, : body[0]] = raw.reshape(body[0], -1).T
    return values.view("<i8").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b" ".join(words))


def _unpack_words(body: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(body).split()


# --- blocks -----------------------------------------------------------------------------------


def word_codes(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words in ``known``, which takes in new ones."""
    parts, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + STRETCH) if len(text) - at > STRETCH else None
        end = cut.start() if cut else len(text)
        words = text[at:end].translate(_LOWER).split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


_BLOCK = "block bigint, is_block boolean, {id}, held_out boolean, n_tokens bigint, body binary, counts binary"
_BLOCK_NAMES = ["block", "is_block", "doc_id", "held_out", "n_tokens", "body", "counts"]


def _block(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """A row per document with its words' codes, and one with the block's words and training counts.

    Codes are by frequency in the block. The block's ``n_tokens`` is that of all its documents.
    """
    known: dict[bytes, int] = {}
    codes = [word_codes(t.as_py().encode(), known) for t in batch.column("text")]
    every = np.concatenate([np.zeros(0, np.int64), *codes])
    order = np.argsort(-np.bincount(every, minlength=len(known)), kind="stable")
    renamed = np.empty(len(order), np.int64)
    renamed[order] = np.arange(len(order))
    held = batch.column("held_out").to_numpy(zero_copy_only=False)
    learned = np.concatenate([np.zeros(0, np.int64), *[c for c, h in zip(codes, held) if not h]])
    counts = np.bincount(renamed[learned], minlength=len(known))
    words = list(known)
    n = batch.num_rows
    doc_id = batch.column("doc_id")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, number)),
            pa.array([False] * n + [True]),
            pa.concat_arrays([doc_id, pa.nulls(1, doc_id.type)]),
            pa.array([*held.tolist(), None], pa.bool_()),
            pa.array([*[len(c) + 1 for c in codes], len(every) + n], pa.int64()),
            pa.array([*[pack(renamed[c]) for c in codes], _pack_words([words[i] for i in order])], pa.binary()),
            pa.array([*[None] * n, pack(counts)], pa.binary()),
        ],
        _BLOCK_NAMES,
    )


def _shares(keys: np.ndarray, n: int) -> list[np.ndarray]:
    """Places of the keys that belong to each of n shards, in order."""
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.searchsorted(keys[order], np.arange(1, n)))


def _word_shares(words: list[bytes], n: int) -> list[np.ndarray]:
    return _shares(np.fromiter((zlib.crc32(w) % n for w in words), np.int64, len(words)), n)


def _words_out(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body, counts in zip(*(batch.column(c) for c in ("block", "body", "counts"))):
                words, counts = _unpack_words(body.as_py()), unpack(counts.as_py())
                shares = [(i, s) for i, s in enumerate(_word_shares(words, n_shards)) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in shares], pa.int64()),
                        pa.array([block.as_py()] * len(shares), pa.int64()),
                        pa.array([_pack_words([words[k] for k in s]) for _, s in shares], pa.binary()),
                        pa.array([pack(counts[s]) for _, s in shares], pa.binary()),
                    ],
                    ["shard", "block", "body", "counts"],
                )

    return run


_ANSWER = "block bigint, is_word boolean, shard bigint, body binary, counts binary, n_total bigint, n_distinct bigint"
_ANSWER_NAMES = ["block", "is_word", "shard", "body", "counts", "n_total", "n_distinct"]


def _answers(blocks, is_word, shard, body, counts, total=None, distinct=None) -> pa.Table:
    """Answers to blocks; the sums of a shard are in a last row without block."""
    last = [] if total is None else [None]
    n = len(blocks)
    return pa.table(
        [
            pa.array([*blocks, *last], pa.int64()),
            pa.array([is_word] * (n + len(last))),
            pa.array([shard] * (n + len(last)), pa.int64()),
            pa.array([*body, *last], pa.binary()),
            pa.array([*counts, *last], pa.binary()),
            pa.array([*[None] * n, *([total] if last else [])], pa.int64()),
            pa.array([*[None] * n, *([distinct] if last else [])], pa.int64()),
        ],
        names=_ANSWER_NAMES,
    )


def _count_words(n_shards: int):
    def run(table: pa.Table) -> pa.Table:
        """Numbers (0 for a word without training count) and counts of each block's words."""
        shard = table["shard"][0].as_py()
        sent = [_unpack_words(b.as_py()) for b in table["body"]]
        coded = pa.array([w for words in sent for w in words], pa.large_binary()).dictionary_encode()
        codes = np.asarray(coded.indices)
        weights = np.concatenate([unpack(c.as_py()) for c in table["counts"]])
        counts = np.bincount(codes, weights, len(coded.dictionary)).astype(np.int64)
        words = np.array(coded.dictionary.to_pylist(), object)
        order = np.lexsort((np.argsort(np.argsort(words)), -counts))
        numbers = np.empty(len(order), np.int64)
        numbers[order] = np.arange(len(order)) * n_shards + shard + 1
        numbers[counts == 0] = 0
        edges = np.cumsum([len(w) for w in sent])[:-1]
        parts = np.split(codes, edges)
        return _answers(
            table["block"].to_pylist(),
            True,
            shard,
            [pack(numbers[p]) for p in parts],
            [pack(counts[p]) for p in parts],
            int(counts.sum()),
            int((counts > 0).sum()),
        )

    return run


# --- pairs ------------------------------------------------------------------------------------


class _Block:
    """A block's documents with the numbers and counts of their words, and their different pairs."""

    def __init__(self, documents: pa.Table, answers: pa.Table, n_words: int, ends: int):
        is_block = documents["is_block"].to_numpy(zero_copy_only=False)
        words = _unpack_words(documents.filter(pa.array(is_block))["body"][0].as_py())
        self.rows = documents.filter(pa.array(~is_block))
        n = len(words)
        # The end is the code after the words.
        self.number, self.count = np.zeros((2, n + 1), np.int64)
        self.number[n], self.count[n] = END, ends
        shares = _word_shares(words, n_words)
        own = answers.filter(answers["is_word"])
        for shard, body, counts in zip(*(own[c] for c in ("shard", "body", "counts"))):
            at = shares[shard.as_py()]
            self.number[at], self.count[at] = unpack(body.as_py()), unpack(counts.as_py())
        codes = [unpack(b.as_py()) for b in self.rows["body"]]
        lengths = np.array([len(c) + 1 for c in codes], np.int64)
        self.tokens = np.full(lengths.sum(), n, np.int64)
        ends_at = np.cumsum(lengths) - 1
        inside = np.ones(len(self.tokens), bool)
        inside[ends_at] = False
        self.tokens[inside] = np.concatenate([np.zeros(0, np.int64), *codes])
        self.starts, self.lengths = ends_at - lengths + 1, lengths
        # The last token before a document's first is the end of the one before it.
        self.before = np.concatenate([[n], self.tokens[:-1]])
        learned = np.repeat(~self.rows["held_out"].to_numpy(zero_copy_only=False), lengths)
        # Only pairs of known words can have been seen.
        self.sent = np.flatnonzero((self.count[self.tokens] > 0) & (self.count[self.before] > 0))
        keys = self.before[self.sent] * (n + 1) + self.tokens[self.sent]
        self.keys, self.pair = np.unique(keys, return_inverse=True)
        self.seen = np.bincount(self.pair, learned[self.sent], len(self.keys)).astype(np.int64)
        self.head, self.tail = self.keys // (n + 1), self.keys % (n + 1)

    def shares(self, n_pairs: int, often: int) -> list[np.ndarray]:
        """Places of the pairs of each shard, by the numbers of their words."""
        first, second = self.number[self.head], self.number[self.tail]
        hot = self.count[self.head] > often
        mixed = (first + np.where(hot, second, 0) * 0x9E3779B1).astype(np.uint64)
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        order = np.lexsort((second, first))
        return [order[s] for s in _shares((mixed % np.uint64(n_pairs)).astype(np.int64)[order], n_pairs)]


def _pairs_out(n_words: int, n_pairs: int, ends: int, often: int):
    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(documents, answers, n_words, ends)
        shares = [(i, s) for i, s in enumerate(block.shares(n_pairs, often)) if len(s)]
        columns = {c: [] for c in ("heads", "runs", "total", "tails", "seen")}
        for _, at in shares:
            heads, first, runs = np.unique(
                block.number[block.head[at]], return_index=True, return_counts=True
            )
            columns["heads"].append(pack(heads))
            columns["runs"].append(pack(runs))
            columns["total"].append(pack(block.count[block.head[at]][first]))
            columns["tails"].append(pack(block.number[block.tail[at]]))
            columns["seen"].append(pack(block.seen[at]))
        return pa.table(
            {
                "shard": pa.array([i for i, _ in shares], pa.int64()),
                "block": pa.array([documents["block"][0].as_py()] * len(shares), pa.int64()),
                **{c: pa.array(v, pa.binary()) for c, v in columns.items()},
            }
        )

    return run


def shard_trie(head: np.ndarray, tail: np.ndarray, seen: np.ndarray, total: np.ndarray, mass: float) -> Trie:
    """Trie over the pairs with training counts, of the shares of these in their first word."""
    some = np.flatnonzero(seen)
    heads, place, at = np.unique(head[some], return_index=True, return_inverse=True)
    width = int(tail.max(initial=0)) + 1
    keys, which = np.unique(at * width + tail[some], return_inverse=True)
    count = np.bincount(which, seen[some], len(keys))
    own = keys // width
    codes = quantised(count / (total[some][place][own] + mass))
    return Trie.of(np.stack([heads[own], keys % width], axis=1), codes)


def _pair_answers(mass: float):
    def run(table: pa.Table) -> pa.Table:
        sent = [
            [unpack(table[c][i].as_py()) for c in ("heads", "runs", "total", "tails", "seen")]
            for i in range(table.num_rows)
        ]
        head = np.concatenate([np.repeat(s[0], s[1]) for s in sent])
        total = np.concatenate([np.repeat(s[2], s[1]) for s in sent])
        tail = np.concatenate([s[3] for s in sent])
        seen = np.concatenate([s[4] for s in sent])
        trie = shard_trie(head, tail, seen, total, mass).mapped()
        body = [
            pack(trie.lookup(np.stack([np.repeat(s[0], s[1]), s[3]], axis=1)).astype(np.int64))
            for s in sent
        ]
        return _answers(
            table["block"].to_pylist(), False, table["shard"][0].as_py(), body, [None] * len(body)
        )

    return run


def _scores(
    n_words: int, n_pairs: int, ends: int, often: int, tokens: int, kinds: int, mass: float
):
    def run(documents: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(documents, answers, n_words, ends)
        codes = np.full(len(block.keys), MISSING, np.int64)
        shares = block.shares(n_pairs, often)
        own = answers.filter(pa.compute.invert(answers["is_word"]))
        for shard, body in zip(own["shard"], own["body"]):
            codes[shares[shard.as_py()]] = unpack(body.as_py())
        alone = (block.count + 1) / (tokens + kinds + 1)
        share = np.zeros(len(block.tokens))
        share[block.sent] = dequantised(codes)[block.pair]
        weight = mass / (block.count[block.before] + mass)
        score = np.log10(share + weight * alone[block.tokens])
        add = lambda values: np.add.reduceat(values, block.starts) if len(block.starts) else values
        n = block.rows.num_rows
        return pa.table(
            {
                "doc_id": block.rows["doc_id"],
                "held_out": block.rows["held_out"],
                "n_tokens": pa.array(block.lengths),
                "n_known": pa.array(add((block.count[block.tokens] > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(n, tokens)),
                "base_score": pa.array(add(np.log10(alone)[block.tokens])),
                "score": pa.array(add(score)),
            }
        )

    return run


def scores(docs: DataFrame, held_out: Column | None = None, mass: float = MASS) -> DataFrame:
    """Base and model log10 probability of every text; the model learns where ``held_out`` is false."""
    held = crc_fold(7) == 2 if held_out is None else held_out
    given = docs.select("doc_id", held.alias("held_out"), whole_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Unique in one run of the step; the written table fixes it for all that follows.
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, size=BLOCK_BYTES):
            yield _block(batch, number)
            number += 1

    doc_id = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    blocks = stage(given.mapInArrow(run, _BLOCK.format(id=doc_id)), "lm-blocks")
    sums = blocks.agg(
        F.sum(F.when(F.col("is_block"), F.col("n_tokens"))).alias("tokens"),
        F.count(F.when(~F.col("is_block") & ~F.col("held_out"), 1)).alias("ends"),
        # Counts are packed at about a byte a word; the number only sizes the shards.
        F.sum(F.octet_length("body")).alias("bytes"),
    ).first()
    ends = sums["ends"]
    n_words = max(1, (sums["bytes"] or 0) // (4 * WORDS_PER_SHARD))
    n_pairs = max(1, (sums["tokens"] or 0) // TOKENS_PER_SHARD)
    words = stage(
        blocks.where("is_block")
        .select("block", "body", "counts")
        .mapInArrow(_words_out(n_words), "shard bigint, block bigint, body binary, counts binary")
        .groupBy("shard")
        .applyInArrow(_count_words(n_words), _ANSWER),
        "lm-words",
    )
    counted = words.where("block IS NULL").agg(F.sum("n_total"), F.sum("n_distinct")).first()
    tokens = (counted[0] or 0) + ends
    kinds = (counted[1] or 0) + (1 if ends else 0)
    by_word = words.where("block IS NOT NULL").withColumnRenamed("block", "of_block")
    pairs = (
        blocks.groupBy("block")
        .cogroup(by_word.groupBy("of_block"))
        .applyInArrow(
            _pairs_out(n_words, n_pairs, ends, HOT),
            "shard bigint, block bigint, heads binary, runs binary, total binary, tails binary, seen binary",
        )
    )
    by_pair = pairs.groupBy("shard").applyInArrow(_pair_answers(mass), _ANSWER)
    both = by_word.unionByName(by_pair.withColumnRenamed("block", "of_block"))
    return (
        blocks.groupBy("block")
        .cogroup(both.groupBy("of_block"))
        .applyInArrow(
            _scores(n_words, n_pairs, ends, HOT, tokens, kinds, mass),
            f"{doc_id}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
            "base_score double, score double",
        )
    )
