"""Operator 6: removal of repeated passages, with a run-length suffix index.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id is
removed; all strings are judged on the input.

Finding where to look. The windows of ``LENGTH`` bytes of a document are put into segments: runs of
windows that share their anchor, the smallest hash of the 24-byte strings in the window. Equal
windows have equal anchors, so equal windows of different documents meet at their anchor. Documents
are spread over blocks by a hash of their id, anchors over buckets. Per block and bucket one message
holds (anchor, hash of the segment's text, smallest id that has it); a bucket replies with two bits
per row: a smaller id has the same segment, or the anchor has several texts and this one
is wanted.

Matching. The wanted texts of a bucket, each once, are indexed: their suffixes are sorted, the
Burrows-Wheeler transform is stored by runs, with the suffix positions at both ends of each run. All
texts are then streamed through the index backwards, one step of the last-to-first mapping at a
time; at every place the matching statistic is compared with ``LENGTH``: rows whose suffixes share
that many bytes form a class, and each class keeps the smallest document id. A window whose class
has a smaller id than its own document is marked. This covers parts of segments that are
equal while the segments differ (edits, ends of copied passages).

Scale: texts are shuffled once, as blocks; messages, replies and marks are packed arrays, so a string
that a third of all documents share is one row per block. Blocks and buckets have bounded sizes. No
step compares pairs.

Defined results: null and empty texts, and texts shorter than a window, are kept whole. Of rows with
the same id none is smaller, so they do not remove each other's text. A null id counts as larger than
any other. Other columns are not read. Segments with equal 64-bit hashes at one anchor count as equal.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import packed, text_bytes, whole_text

LENGTH = 50
GRAM = 24
MOST_WINDOWS = 64
CHUNK_BYTES = 1 << 18
_NULL_ID = np.int64(np.iinfo(np.int64).max)

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(30))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64))
_SIZE = CHUNK_BYTES + 1
_POWERS = np.concatenate(
    [[np.uint64(1)], np.multiply.accumulate(np.full(_SIZE, _BASE, np.uint64))]
)
_BACK = np.concatenate(
    [[np.uint64(1)], np.multiply.accumulate(np.full(_SIZE, pow(_BASE, -1, 1 << 64), np.uint64))]
)


# --- segments of a block ----------------------------------------------------------------------


def _segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """First window, last window, anchor, text hash and document of the segments of some texts."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    wide = np.concatenate([data, np.zeros(GRAM, np.uint8)])

    def longs(at: int) -> np.ndarray:
        return np.ndarray((n,), "<u8", wide, at, (1,))

    grams = longs(0) * np.uint64(_BASE)
    grams ^= grams >> np.uint64(29)
    grams = (grams + longs(8)) * _M2
    grams ^= grams >> np.uint64(32)
    grams = _mix(grams + longs(16))
    least, size, span = grams, 1, LENGTH - GRAM + 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    windows = n - LENGTH + 1
    least = least[:windows]
    # A run ends where the anchor changes, at the end of a text, and after MOST_WINDOWS windows.
    starts = np.zeros(windows + 1, bool)
    np.not_equal(least[1:], least[:-1], out=starts[1:windows])
    inner = offsets[:-1][offsets[:-1] < windows]
    starts[inner] = True
    starts[0] = True
    first = np.flatnonzero(starts[:windows])
    owner = np.searchsorted(offsets, first, side="right") - 1
    final = np.append(first[1:], windows) - 1
    final = np.minimum(final, offsets[owner + 1] - LENGTH)
    real = final >= first
    first, final, owner = first[real], final[real], owner[real]
    parts = (final - first) // MOST_WINDOWS + 1
    if len(parts) and parts.max() > 1:
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, final, owner = (np.repeat(x, parts) for x in (first, final, owner))
        first = first + step * MOST_WINDOWS
        final = np.minimum(final, first + MOST_WINDOWS - 1)
    anchor = least[first]
    text = np.empty(len(first), np.uint64)
    # Text hashes by prefix sums, in chunks that the power tables cover.
    lo = 0
    while lo < len(first):
        base = first[lo]
        hi = int(np.searchsorted(first, base + CHUNK_BYTES - LENGTH - MOST_WINDOWS, side="left"))
        hi = max(hi, lo + 1)
        end = int(final[hi - 1]) + LENGTH
        sums = np.zeros(end - base + 1, np.uint64)
        np.cumsum(_BYTE[data[base:end]] * _POWERS[: end - base], out=sums[1:])
        a, b = first[lo:hi] - base, final[lo:hi] + LENGTH - base
        text[lo:hi] = (sums[b] - sums[a]) * _BACK[a] + (b - a).astype(np.uint64)
        lo = hi
    return first, final, anchor, _mix(text), owner


@dataclass
class Block:
    """Texts of a block in order of their ids, with their segments grouped by equal text.

    ``group`` numbers each segment's group. Groups are ordered by (bucket, smallest id, anchor,
    text); ``edges`` are the first groups of each bucket.
    """

    order: np.ndarray
    ids: np.ndarray
    null_id: np.ndarray
    offsets: np.ndarray
    data: np.ndarray
    first: np.ndarray
    final: np.ndarray
    owner: np.ndarray
    group: np.ndarray
    least: np.ndarray
    anchor: np.ndarray
    text: np.ndarray
    example: np.ndarray
    edges: np.ndarray


def read_block(table: pa.Table, buckets: int) -> Block:
    ids = table.column("doc_id").combine_chunks()
    null_id = np.asarray(ids.is_null().cast(pa.uint8())) > 0
    ids = np.asarray(ids.fill_null(int(_NULL_ID)))
    order = np.argsort(ids, kind="stable")
    texts = table.column("text").cast(pa.large_string()).combine_chunks()
    offsets, data = packed(texts.take(pa.array(order)))
    ids, null_id = ids[order], null_id[order]
    found, lo = [], 0
    while lo < len(ids):  # chunks of whole texts, small enough for the processor's cache
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1
        hi = min(max(hi, lo + 1), len(ids))
        base = offsets[lo]
        a, b, v, t, own = _segments(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
        found.append((a + base, b + base, v, t, own + lo))
        lo = hi
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    first, final, anchor, text, owner = map(np.concatenate, zip(empty, *found))
    # Segments of one text and anchor are one group; ids ascend, so its first has the smallest.
    key = _mix(anchor ^ (text * _M2)) ^ text
    by = np.lexsort((anchor, key)) if len(key) else np.zeros(0, np.int64)
    new = np.ones(len(by), bool)
    new[1:] = (key[by][1:] != key[by][:-1]) | (anchor[by][1:] != anchor[by][:-1])
    example = np.minimum.reduceat(by, np.flatnonzero(new)) if len(by) else by
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(new) - 1
    bucket = (_mix(anchor[example]) % np.uint64(buckets)).astype(np.int64)
    ranked = np.lexsort((text[example], anchor[example], owner[example], bucket))
    place = np.empty(len(ranked), np.int64)
    place[ranked] = np.arange(len(ranked))
    example = example[ranked]
    return Block(
        order, ids, null_id, offsets, data, first, final, owner, place[number] if len(by) else number,
        ids[owner[example]], anchor[example], text[example], example,
        np.searchsorted(bucket[ranked], np.arange(buckets + 1)),
    )


# --- messages --------------------------------------------------------------------------------


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ascending ids: the first, then steps in as few bytes as the largest needs."""
    steps = np.diff(ids).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if not len(steps) or int(steps.max()) < 1 << (8 * w))
    return ids[:1].tobytes() + bytes([width]) + steps.astype(f"<u{width}").tobytes()


def _unpack_ids(raw: bytes, n: int) -> tuple[np.ndarray, int]:
    width = raw[8]
    steps = np.frombuffer(raw, f"<u{width}", n - 1, 9).astype(np.int64)
    ids = np.frombuffer(raw, np.int64, 1)[0] + np.concatenate([[0], np.cumsum(steps)])
    return ids, 9 + width * (n - 1)


def question(block: Block, bucket: int) -> bytes:
    """The groups of one bucket: ids, 40 bits of the anchor, text hash."""
    lo, hi = block.edges[bucket], block.edges[bucket + 1]
    anchor = (block.anchor[lo:hi] >> np.uint64(8)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    count = np.array([hi - lo], "<u4").tobytes()
    return count + _pack_ids(block.least[lo:hi]) + anchor.tobytes() + block.text[lo:hi].tobytes()


def read_question(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ids, used = _unpack_ids(raw[4:], n)
    at = 4 + used
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8, 5 * n, at).reshape(n, 5)
    return ids, wide.view("<u8").ravel(), np.frombuffer(raw, "<u8", n, at + 5 * n)


def answers(questions: list[bytes]) -> list[bytes]:
    """For each block's groups: bits that a smaller id has the text, bits that the text is wanted."""
    parts = [read_question(q) for q in questions]
    sizes = [len(p[0]) for p in parts]
    ids, anchor, text = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, text, anchor))
    a, t = anchor[order], text[order]
    new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
    new_text = new_anchor | np.concatenate([[True], t[1:] != t[:-1]])
    smallest = ids[order][np.flatnonzero(new_text)][np.cumsum(new_text) - 1]
    several = np.add.reduceat(new_text, np.flatnonzero(new_anchor), dtype=np.int64) > 1
    covered, wanted = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    covered[order] = ids[order] > smallest
    wanted[order] = new_text & several[np.cumsum(new_anchor) - 1]
    edges = np.cumsum([0, *sizes])
    return [
        np.packbits(covered[x:y]).tobytes() + np.packbits(wanted[x:y]).tobytes()
        for x, y in zip(edges[:-1], edges[1:])
    ]


def read_answer(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = -(-n // 8)
    bits = np.frombuffer(raw, np.uint8)
    covered = np.unpackbits(bits[:size], count=n) if n else np.zeros(0, np.uint8)
    wanted = np.unpackbits(bits[size:], count=n) if n else np.zeros(0, np.uint8)
    return covered > 0, wanted > 0


def wanted_texts(block: Block, bucket: int, wanted: np.ndarray) -> bytes:
    """Numbers, ids, sizes and texts of the wanted groups."""
    rows = np.flatnonzero(wanted)
    groups = block.edges[bucket] + rows
    at = block.example[groups]
    begin, size = block.first[at], block.final[at] - block.first[at] + LENGTH
    ends = np.cumsum(size)
    where = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
    return b"".join(
        [
            np.array([len(rows)], "<u4").tobytes(),
            rows.astype("<u4").tobytes(),
            block.least[groups].tobytes(),
            size.astype("<u1").tobytes(),
            block.data[where].tobytes(),
        ]
    )


def read_texts(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    rows = np.frombuffer(raw, "<u4", n, 4)
    ids = np.frombuffer(raw, np.int64, n, 4 + 4 * n)
    sizes = np.frombuffer(raw, "<u1", n, 4 + 12 * n).astype(np.int64)
    return rows, ids, sizes, np.frombuffer(raw, np.uint8, sizes.sum(), 4 + 13 * n)


# --- the index ---------------------------------------------------------------------------------


class _Bits:
    """Set positions below ``n``, with their number up to any position in constant time."""

    def __init__(self, positions: np.ndarray, n: int):
        bits = np.zeros((n // 64 + 1) * 64, np.uint8)
        bits[positions] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def last(self, at: np.ndarray) -> np.ndarray:
        """Index, among the set positions, of the last one at or before each position."""
        word = at >> 6
        seen = self.words[word] & (_ALL >> (63 - (at & 63)).astype(np.uint64))
        return self.before[word] + np.bitwise_count(seen) - 1


_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes in order; text ends (symbol 0) differ and are ordered by text.

    Prefix doubling from seven symbols on, where only suffixes that still share their rank with
    another are sorted again. A rank is the row of the first suffix that has it.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([symbols, np.zeros(7, np.int64)])
    open_ = np.ones(n, bool)  # no end among the symbols so far
    for k in range(7):
        key = (key << 9) | np.where(open_, padded[k : k + n], 0)
        open_ &= padded[k : k + n] != 0
    # Suffixes with an end among the first seven symbols differ by that end: equal keys are told
    # apart by the text, which for them is the order of position.
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | ~open_[order][1:]
    size, same = 7, ~fresh
    ranks = np.empty(n, np.int64)
    ranks[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while same.any():
        tied = same.copy()
        tied[:-1] |= same[1:]
        rows = np.flatnonzero(tied)
        at = order[rows]
        group = ranks[at]
        ahead = ranks[at + size]  # there is one: tied suffixes have no end among their symbols
        by = np.lexsort((ahead, group)) if n > 1 << 31 else np.argsort(group * n + ahead)
        at, group, ahead = at[by], group[by], ahead[by]
        order[rows] = at
        new = np.ones(len(rows), bool)
        new[1:] = (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])
        same[rows] = ~new
        ranks[at] = np.maximum.accumulate(np.where(new, rows, 0))
        size *= 2
    return order


def _shares(symbols: np.ndarray, order: np.ndarray, room: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in order has ``length`` symbols before its text's end and shares them with
    the one above. Compared eight symbols at a time, for those that agree so far."""
    result = np.zeros(len(order), bool)
    rows = np.flatnonzero((room[1:] >= length) & (room[:-1] >= length)) + 1
    data = np.concatenate([(symbols - 1).astype(np.uint8), np.zeros(8, np.uint8)])
    longs = np.ndarray((len(symbols),), "<u8", data, 0, (1,))
    for at in [*range(0, length - 7, 8), *([length - 8] if length >= 8 else [])]:
        rows = rows[longs[order[rows] + at] == longs[order[rows - 1] + at]]
    if length < 8:
        for at in range(length):
            rows = rows[data[order[rows] + at] == data[order[rows - 1] + at]]
    result[rows] = True
    return result


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a set of texts.

    ``heads`` and ``starts``: symbol and first row of each run; ``before``: how often the symbol
    occurs in earlier runs; ``samples``: text position at the first and last row of each run.
    Symbol 0 ends a text (ends are ordered by text), byte ``b`` is symbol ``b + 1``. ``classes`` are
    the first rows of the sets of suffixes that share ``length`` bytes, ``owners`` their smallest id.
    Runs and classes are found from a row through bit vectors.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int = LENGTH):
        texts = len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        n = int(ends[-1]) + 1 if texts else 0
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols[inside] = data.astype(np.int64) + 1
        self.length, self.ends, self.n = length, ends, n
        order = _suffix_order(symbols, ends)
        self.order = order
        of_text = np.repeat(np.arange(texts), sizes + 1)[order]
        first = ~_shares(symbols, order, ends[of_text] - order, length)
        self.classes = np.flatnonzero(first)
        self.owners = np.minimum.reduceat(ids[of_text], self.classes) if n else np.zeros(0, int)
        previous = symbols[order - 1]  # before position 0 stands the last end
        change = np.concatenate([[True], previous[1:] != previous[:-1]]) if n else np.zeros(0, bool)
        self.starts = np.flatnonzero(change)
        self.heads = previous[self.starts]
        lengths = np.diff(np.append(self.starts, n))
        by = np.argsort(self.heads, kind="stable")
        sums = np.cumsum(lengths[by]) - lengths[by]
        heads = self.heads[by]
        lowest = sums[np.searchsorted(heads, heads)] if n else sums
        self.before = np.empty(len(by), np.int64)
        self.before[by] = sums - lowest
        counts = np.bincount(symbols, minlength=258)
        self.below = np.cumsum(counts) - counts
        last = np.append(self.starts[1:], n) - 1
        self.samples = (order[self.starts], order[last])
        self.run_bits, self.class_bits = _Bits(self.starts, n), _Bits(self.classes, n)

    def back(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes one symbol longer, and that symbol (last-to-first mapping)."""
        run = self.run_bits.last(rows)
        head = self.heads[run]
        return self.below[head] + self.before[run] + rows - self.starts[run], head

    def locate(self, row: int) -> int:
        """Text position of a row: steps back until a row at the end of a run is met."""
        steps = 0
        while True:
            run = int(self.run_bits.last(np.array([row]))[0])
            last = (self.starts[run + 1] if run + 1 < len(self.starts) else self.n) - 1
            if row == self.starts[run]:
                return int(self.samples[0][run]) + steps
            if row == last:
                return int(self.samples[1][run]) + steps
            row = int(self.back(np.array([row]))[0][0])
            steps += 1

    def owners_along(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Streams every text backwards from its end: (text, place, smallest id of the class) for
        every place that has ``length`` bytes before the text's end."""
        live = np.arange(len(sizes))
        rows = np.arange(len(sizes))  # an end is the row of its text's number
        texts, places, owners = [], [], []
        for done in range(1, int(sizes.max(initial=0)) + 1):
            more = sizes[live] >= done
            if not more.all():
                live, rows = live[more], rows[more]
            rows, _ = self.back(rows)
            if done >= self.length:
                texts.append(live)
                places.append(sizes[live] - done)
                owners.append(self.owners[self.class_bits.last(rows)])
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        return join(texts), join(places), join(owners)


def marks(messages: list[bytes]) -> list[bytes]:
    """For each block's texts: which windows (bits of a number) occur in a smaller document."""
    parts = [read_texts(m) for m in messages]
    ids, sizes = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    index = RunIndex(np.concatenate([p[3] for p in parts]), sizes, ids)
    text, place, owner = index.owners_along(sizes)
    hit = owner < ids[text]
    bits = np.zeros(len(sizes), np.uint64)
    np.bitwise_or.at(bits, text[hit], np.uint64(1) << place[hit].astype(np.uint64))
    edges = np.cumsum([0, *[len(p[0]) for p in parts]])
    out = []
    for (rows, *_), lo, hi in zip(parts, edges[:-1], edges[1:]):
        some = np.flatnonzero(bits[lo:hi])
        out.append(rows[some].astype("<u4").tobytes() + bits[lo:hi][some].tobytes())
    return out


# --- results ---------------------------------------------------------------------------------


def removed_bytes(block: Block, replies: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Which bytes of a block go, by its buckets' answers (kind 0) and marks (kind 1)."""
    gone = np.zeros(len(block.data) + 1, np.int32)

    def remove(begin: np.ndarray, end: np.ndarray) -> None:
        np.add.at(gone, begin, 1)
        np.add.at(gone, end, -1)

    covered = np.zeros(len(block.least), bool)
    bits = np.zeros(len(block.least), np.uint64)
    for bucket, kind, raw in replies:
        lo, hi = block.edges[bucket], block.edges[bucket + 1]
        if kind == 0:
            covered[lo:hi] = read_answer(raw, hi - lo)[0]
        else:
            n = len(raw) // 12
            bits[lo + np.frombuffer(raw, "<u4", n)] = np.frombuffer(raw, "<u8", n, 4 * n)
    whole = covered[block.group] | (block.ids[block.owner] > block.least[block.group])
    remove(block.first[whole], block.final[whole] + LENGTH)
    part = np.flatnonzero(~whole & (bits[block.group] > 0))
    for window in range(MOST_WINDOWS):
        on = part[(bits[block.group[part]] >> np.uint64(window)) & np.uint64(1) > 0]
        remove(block.first[on] + window, block.first[on] + window + LENGTH)
    return np.cumsum(gone[:-1]) > 0


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _digests(block: Block, gone: np.ndarray) -> dict[str, pa.Array]:
    total = np.concatenate([[0], np.cumsum(gone)])
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = block.offsets[:-1][block.offsets[:-1] < len(gone)]
    begins[inner] = gone[inner]
    spans = np.concatenate([[0], np.cumsum(begins)])
    lo, hi = block.offsets[:-1], block.offsets[1:]
    removed = total[hi] - total[lo]
    digests = []
    for a, b, r in zip(lo.tolist(), hi.tolist(), removed.tolist()):
        kept = block.data[a:b] if not r else block.data[a:b][~gone[a:b]]
        digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
    return {
        "doc_id": pa.array(block.ids, mask=block.null_id),
        "n_bytes": pa.array(hi - lo),
        "n_removed": pa.array(removed),
        "n_spans": pa.array(spans[hi] - spans[lo]),
        "kept_sha256": pa.array(digests, pa.string()),
    }


def sizing(docs: DataFrame) -> tuple[int, int]:
    """Numbers of blocks and buckets: about 4 MB of text a block up to 4096 blocks, then 128 MB."""
    size = text_bytes(docs)
    blocks = max(16, min(4096, size >> 22), size >> 27)
    return blocks, max(64, min(16384, 2 * blocks))


_MESSAGE = "bucket int, block int, payload binary"
_REPLY = "block int, bucket int, kind int, payload binary"


def _plans(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Texts by block, replies by block (answers and marks), number of buckets."""
    blocks, buckets = sizing(docs)
    spread = docs.withColumn(
        "block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    ).repartition(blocks, "block")

    def ask(table: pa.Table) -> pa.Table:
        block = read_block(table, buckets)
        full = np.flatnonzero(np.diff(block.edges))
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "block": pa.array([table.column("block")[0].as_py()] * len(full), pa.int32()),
                "payload": pa.array([question(block, int(b)) for b in full], pa.binary()),
            }
        )

    def reply(table: pa.Table) -> pa.Table:
        raw = answers(table.column("payload").to_pylist())
        return _replies(table, raw, 0)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "block": [], "payload": []}
        if left.num_rows and right.num_rows:
            block = read_block(left, buckets)
            for bucket, raw in zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist()):
                n = int(block.edges[bucket + 1] - block.edges[bucket])
                wanted = read_answer(raw, n)[1]
                if wanted.any():
                    out["bucket"].append(bucket)
                    out["block"].append(right.column("block")[0].as_py())
                    out["payload"].append(wanted_texts(block, bucket, wanted))
        types = {"bucket": pa.int32(), "block": pa.int32(), "payload": pa.binary()}
        return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})

    def match(table: pa.Table) -> pa.Table:
        return _replies(table, marks(table.column("payload").to_pylist()), 1)

    asked = spread.groupBy("block").applyInArrow(ask, _MESSAGE)
    replies = asked.groupBy("bucket").applyInArrow(reply, _REPLY)
    sent = spread.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(send, _MESSAGE)
    marked = sent.groupBy("bucket").applyInArrow(match, _REPLY)
    return spread, replies.unionByName(marked), buckets


def _replies(table: pa.Table, raw: list[bytes], kind: int) -> pa.Table:
    return pa.table(
        {
            "block": table.column("block").cast(pa.int32()),
            "bucket": table.column("bucket").cast(pa.int32()),
            "kind": pa.array([kind] * table.num_rows, pa.int32()),
            "payload": pa.array(raw, pa.binary()),
        }
    )


def _read_replies(table: pa.Table) -> list[tuple[int, int, bytes]]:
    return list(zip(*[table.column(n).to_pylist() for n in ("bucket", "kind", "payload")]))


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    spread, replies, buckets = _plans(slim)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = read_block(left, buckets)
        return pa.table(_digests(block, removed_bytes(block, _read_replies(right))))

    return spread.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, RESULT)


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with every nested field nullable, as a schema string declares it."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(_nullable(kind.value_type))
    return kind


def without_passages(docs: DataFrame) -> DataFrame:
    """The documents with the repeated bytes taken out of their texts, other columns as they are
    (``n_chars`` is counted anew where there is one).

    A character cut in two by an edge goes as a whole. A document of which nothing but white space
    is left goes, unless it had no more before.
    """
    others = [F.col(c) for c in docs.columns if c != "text"]
    slim = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        whole_text().alias("text"),
        F.struct(*others).alias("row"),
        F.col("text").isNull().alias("was_null"),
    )
    spread, replies, buckets = _plans(slim)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = read_block(left, buckets)
        gone = removed_bytes(block, _read_replies(right))
        changed = np.add.reduceat(
            np.append(gone, False), block.offsets[:-1], dtype=np.int64
        ) * (np.diff(block.offsets) > 0)
        rows = left.take(pa.array(block.order))
        texts, keep = [], np.ones(len(block.ids), bool)
        nulls = rows.column("was_null").to_pylist()
        for i, (a, b) in enumerate(zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())):
            kept = block.data[a:b] if not changed[i] else block.data[a:b][~gone[a:b]]
            text = kept.tobytes().decode("utf-8", "ignore")
            keep[i] = not (changed[i] and not text.strip())
            texts.append(None if nulls[i] else text)
        row = rows.column("row")
        table = pa.table({"text": pa.array(texts, pa.string()), "row": row.cast(_nullable(row.type))})
        return table.filter(pa.array(keep))

    row_type = slim.schema["row"].dataType
    left = spread.groupBy("block").cogroup(replies.groupBy("block"))
    found = left.applyInArrow(finish, f"text string, row {row_type.simpleString()}")
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.length("text").cast(kind)
    return found.select(
        *[F.col("text") if c == "text" else columns[c].alias(c) for c in docs.columns]
    )
