"""Operator 10: packing of token sequences by column generation.

A document is its token ids and a closing id 0. It is cut after every ``CAPACITY`` ids; full pieces
are sequences of their own. The rest is cut once more, at the last multiple of ``GRID``, so that
pieces have few different lengths (multiples of the grid, and less than the grid); over all
lengths the linear program would take minutes and end with more padding [measured]. How many pieces
of each length exist is a histogram of about 60 numbers, whatever the data; a linear program over patterns
(how many pieces of each length share a sequence) covers it with the fewest sequences. Patterns
are generated as columns: a knapsack over the dual prices finds the next one. The solution is
rounded down, and what is left (less than one sequence per pattern) is packed best fit, longest
first. Only the histogram and the plan, both bounded by the capacity, pass through the driver.

Pieces are then ranked within their length and take the plan's places in that order. Ranks are
made in two levels (counts per length and block of documents, then inside a block), so a length
that a third of all pieces share is no single task.

Defined results: a null or empty text is the closing id alone. Repeated rows are packed like
any others; equal rows (same id and text) are interchangeable. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.staging import stage

CAPACITY = 1024
GRID = 32
CLOSING = 0
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
GAP = 1.002
MOST_COLUMNS = 4000
_FAR = 1 << 40


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Function from a text to its ids, equal to the tokenizer file's.

    The file is a byte-level BPE whose merges are in the order of their ids, so the ranks of the
    tiktoken encoder are the ids, and that encoder gives the same ids several times faster.
    Texts that hold a special token of the file are left to the file's own library.
    """
    import tiktoken
    from tokenizers import Tokenizer, pre_tokenizers

    own = Tokenizer.from_file(path)
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    # The printable stand-ins of the byte-level alphabet, in the order of the bytes they are for.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in stand_in:
            stand_in[b] = chr(extra)
            extra += 1
    if set(stand_in.values()) != set(pre_tokenizers.ByteLevel.alphabet()):
        raise ValueError("not a byte-level vocabulary")
    back = {c: b for b, c in stand_in.items()}
    ranks = {
        bytes(back[c] for c in token): number
        for token, number in own.get_vocab(with_added_tokens=False).items()
        if token not in special
    }
    fast = tiktoken.Encoding(
        "fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return own.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(
    docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, grid: int = GRID
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for number, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), CLOSING], "<u4")
                cuts = [*range(0, len(ids), capacity)]
                if len(ids) - cuts[-1] > grid and (len(ids) - cuts[-1]) % grid:
                    cuts.append(len(ids) - (len(ids) - cuts[-1]) % grid)
                for at, end in zip(cuts, [*cuts[1:], len(ids)]):
                    piece = ids[at:end]
                    row.append(number)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc, total)],
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )


# --- the linear program ---------------------------------------------------------------------


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Best total price of pieces that fit the capacity, and how many of each (by index)."""
    useful = np.flatnonzero(prices > 1e-12)
    size, price = lengths[useful], prices[useful]
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = fits[room]
        if n:
            value = best[room - size[:n]] + price[:n]
            k = int(value.argmax())
            if value[k] > best[room] + 1e-15:
                best[room], pick[room] = value[k], k
    room, chosen = capacity, {}
    while room > 0:
        if pick[room] < 0:
            room -= 1
            continue
        item = int(useful[pick[room]])
        chosen[item] = chosen.get(item, 0) + 1
        room -= int(lengths[item])
    return float(best[capacity]), chosen


def fractional_plan(
    lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP
) -> tuple[list[dict[int, int]], np.ndarray]:
    """Patterns (index of length -> pieces) and how often each is used, as a basis of the linear
    program ``min sum x`` with all demands met exactly.

    Revised simplex on columns priced by the knapsack; ends within ``gap`` of the lower bound
    that the prices prove, or after ``MOST_COLUMNS`` columns with what has been reached.
    """
    m = len(lengths)
    patterns = [{i: int(capacity // lengths[i])} for i in range(m)]
    copies = np.array([capacity // x for x in lengths], float)
    inverse = np.diag(1 / copies)
    used = demand / copies
    for _ in range(MOST_COLUMNS):
        prices = inverse.sum(axis=0)
        value, column = knapsack(prices, lengths, capacity)
        if value <= 1 + 1e-9 or used.sum() <= gap * (prices @ demand) / value:
            break
        moved = sum(inverse[:, i] * n for i, n in column.items())
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(moved > 1e-9, used / moved, np.inf)
        out = int(room.argmin())
        step = room[out]
        used = np.maximum(used - step * moved, 0)
        used[out] = step
        row = inverse[out] / moved[out]
        inverse -= np.outer(moved, row)
        inverse[out] = row
        patterns[out] = column
    return patterns, used


def best_fit(left: list[int], capacity: int) -> list[list[int]]:
    """Pieces, longest first, each into the fullest sequence that takes it."""
    rooms: list[tuple[int, int]] = []
    filled: list[list[int]] = []
    for length in sorted(left, reverse=True):
        at = bisect_left(rooms, (length, -1))
        if at == len(rooms):
            room, number = capacity, len(filled)
            filled.append([])
        else:
            room, number = rooms.pop(at)
        filled[number].append(length)
        if room > length:
            insort(rooms, (room - length, number))
    return filled


@dataclass
class Plan:
    """Places by length: from rank ``first`` on, ``each`` pieces per sequence from ``base`` on."""

    keys: np.ndarray  # length * 2**40 + first, ascending
    base: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece with each rank (from 0) in its length."""
        key = lengths * _FAR + ranks
        at = np.searchsorted(self.keys, key, side="right") - 1
        beyond = key - self.keys[at]
        each = self.each[at]
        return self.base[at] + beyond // each, self.offset[at] + beyond % each * lengths


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Places for all pieces of a histogram of lengths (1 to ``capacity``)."""
    shares: list[tuple[int, list[tuple[int, int]]]] = []
    if histogram.get(capacity):
        shares.append((histogram[capacity], [(capacity, 1)]))
    lengths = np.array(sorted(x for x, n in histogram.items() if n and x < capacity), np.int64)
    if len(lengths):
        demand = np.array([histogram[int(x)] for x in lengths], np.int64)
        patterns, used = fractional_plan(lengths, demand.astype(float), capacity)
        left = demand.copy()
        for pattern, times in zip(patterns, used):
            times = int(times + 1e-7)
            times = min([times, *[int(left[i]) // n for i, n in pattern.items()]])
            if times > 0:
                for i, n in pattern.items():
                    left[i] -= n * times
                shares.append((times, [(int(lengths[i]), n) for i, n in sorted(pattern.items(), reverse=True)]))
        rest = [int(x) for x, n in zip(lengths, left) for _ in range(int(n))]
        for pieces in best_fit(rest, capacity):
            shares.append((1, [(x, pieces.count(x)) for x in sorted(set(pieces), reverse=True)]))
    rows, base, seen = [], 0, {}
    for times, pieces in shares:
        offset = 0
        for length, each in pieces:
            rows.append((length * _FAR + seen.get(length, 0), base, each, offset))
            seen[length] = seen.get(length, 0) + each * times
            offset += each * length
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], base)


# --- ranks and places ---------------------------------------------------------------------------


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    pieces = stage(cut(docs, vocabulary, capacity), "pieces")
    blocks = max(64, pieces.count() // 4096)
    pieces = pieces.withColumn(
        "_block", F.pmod(F.xxhash64("doc_id", "doc_tokens", "start"), F.lit(blocks))
    )
    counts = stage(pieces.groupBy("length", "_block").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {
        r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    }
    places = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "length", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("length", "_block").orderBy(
        "doc_id", "start", "doc_tokens", "ids_crc32"
    )
    ranked = pieces.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(offsets, ["length", "_block"]).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("_before") + F.col("_rank")).cast("bigint").alias("_rank"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sequence, offset = places.place(
                np.asarray(batch.column("length")), np.asarray(batch.column("_rank"))
            )
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema[:5])
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")
