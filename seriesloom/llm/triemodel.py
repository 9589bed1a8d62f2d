"""Compact n-gram tries: monotone sequences in Elias-Fano form, searched relative to their context.

``EliasFano`` keeps the high bits of ascending numbers in unary and the low bits packed; ``Trie`` holds
one such sequence of ids and one of pointers per level, with quantised probabilities at the last. All
arrays are slices of one buffer, so a trie can be mapped from a file. Every method takes and
gives arrays.
"""

from __future__ import annotations

import mmap
import tempfile
from dataclasses import dataclass

import numpy as np

MISSING = 0xFFFF
# Steps of a tenth power that a quantised probability tells apart.
STEPS = 4096


def quantised(share: np.ndarray) -> np.ndarray:
    """Probabilities (over 1e-15) as codes, the larger the less likely."""
    return np.clip(np.rint(-np.log10(share) * STEPS), 0, MISSING - 1).astype(np.uint16)


def dequantised(codes: np.ndarray) -> np.ndarray:
    """Probabilities of codes; that of a missing entry is 0."""
    return np.where(codes == MISSING, 0.0, 10.0 ** (codes / -STEPS))


def _select_in_word(words: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Place of the rest-th (from 0) set bit of each word."""
    words, rest = words.copy(), rest.astype(np.int64)
    place = np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & np.uint64((1 << width) - 1)).astype(np.int64)
        beyond = rest >= low
        rest -= np.where(beyond, low, 0)
        words = np.where(beyond, words >> np.uint64(width), words)
        place += np.where(beyond, width, 0)
    return place


@dataclass
class EliasFano:
    """Ascending numbers from 0; ``high`` has a set bit per number, ``upto`` the ones before a word."""

    size: int
    bits: int
    high: np.ndarray
    upto: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        places = (values >> bits) + np.arange(n)
        # One zero closes each bucket, so the last bucket has one too.
        words = (n + (top >> bits) + 2) // 64 + 1
        flags = np.zeros(words * 64, np.uint8)
        flags[places] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(high).astype(np.int64)
        parts = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        packed = np.packbits(parts.ravel(), bitorder="little")
        low = np.zeros((n * bits) // 64 + 2, np.uint64)
        low.view(np.uint8)[: len(packed)] = packed
        return cls(n, bits, high, (np.cumsum(ones) - ones).astype(np.uint32), low)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.int64)
        bit = at * self.bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        left = self.low[word] >> shift
        # A shift by 64 is undefined, so the next word is moved in two steps.
        right = (self.low[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return ((left | right) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _ones(self, k: np.ndarray) -> np.ndarray:
        """Bit of the k-th one."""
        word = np.searchsorted(self.upto, k, side="right") - 1
        return (word << 6) + _select_in_word(self.high[word], k - self.upto[word])

    def _zeros(self, k: np.ndarray) -> np.ndarray:
        """Bit of the k-th zero."""
        before = (np.arange(len(self.upto)) << 6) - self.upto
        word = np.searchsorted(before, k, side="right") - 1
        return (word << 6) + _select_in_word(~self.high[word], k - before[word])

    def get(self, at: np.ndarray) -> np.ndarray:
        """Numbers at places."""
        return ((self._ones(at) - at) << self.bits) | self._low(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value's first occurrence, or -1: bucket by the high bits, halving inside."""
        found = np.full(len(values), -1, np.int64)
        if not self.size:
            return found
        last = int(self.get(np.array([self.size - 1]))[0])
        inside = np.flatnonzero((values >= 0) & (values <= last))
        bucket = values[inside] >> self.bits
        low = values[inside] & ((1 << self.bits) - 1)
        start = np.where(bucket > 0, self._zeros(np.maximum(bucket - 1, 0)) - (bucket - 1), 0)
        end = self._zeros(bucket) - bucket
        lo, hi = start.copy(), end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._low(middle) < low[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
        hit = lo < end
        hit[hit] = self._low(lo[hit]) == low[hit]
        found[inside[hit]] = lo[hit]
        return found

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.size, self.bits], np.int64), self.high, self.upto, self.low]

    @classmethod
    def back(cls, parts: list[np.ndarray]) -> EliasFano:
        (size, bits), high, upto, low = parts
        return cls(int(size), int(bits), high, upto, low)


@dataclass
class Trie:
    """Levels of (pointers, ids): the successors of node i have places pointers[i] to pointers[i+1].

    Ids ascend inside a range; a range continues from the last number of the one before, which
    makes a level one ascending sequence. ``codes`` belong to the last level.
    """

    levels: list[tuple[EliasFano, EliasFano]]
    codes: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, codes: np.ndarray) -> Trie:
        """From different n-grams (rows of ids) in ascending order, and a code for each."""
        levels, n_before = [], 1
        node = np.zeros(len(grams), np.int64)  # parent of each row
        for order in range(grams.shape[1]):
            column = grams[:, order]
            first = np.ones(len(grams), bool)
            first[1:] = (node[1:] != node[:-1]) | (column[1:] != column[:-1])
            parents, ids = node[first], column[first]
            counts = np.bincount(parents, minlength=n_before)
            ends = np.cumsum(counts)
            last = np.where(counts > 0, ids[np.maximum(ends, 1) - 1] + 1 if len(ids) else 0, 0)
            base = np.cumsum(last) - last
            levels.append(
                (EliasFano.of(np.concatenate([[0], ends])), EliasFano.of(base[parents] + ids + 1))
            )
            node = np.cumsum(first) - 1
            n_before = len(ids)
        return cls(levels, codes.astype(np.uint16))

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """Code of each n-gram (rows of ids), or ``MISSING``."""
        rows = np.arange(len(grams))
        node = np.zeros(len(grams), np.int64)
        for order, (pointers, ids) in enumerate(self.levels):
            begin, end = pointers.get(node), pointers.get(node + 1)
            some = end > begin
            rows, begin, end = rows[some], begin[some], end[some]
            base = np.zeros(len(rows), np.int64)
            base[begin > 0] = ids.get(begin[begin > 0] - 1)
            place = ids.find(base + grams[rows, order] + 1)
            hit = (place >= begin) & (place < end)
            rows, node = rows[hit], place[hit]
        codes = np.full(len(grams), MISSING, np.uint16)
        codes[rows] = self.codes[node]
        return codes

    def mapped(self) -> Trie:
        """The same trie in a file without a name, mapped read-only; gone with its last use."""
        parts = [a for level in self.levels for one in level for a in one.arrays()] + [self.codes]
        with tempfile.TemporaryFile() as file:
            places = []
            for part in parts:
                places.append((file.tell(), part.dtype, len(part)))
                file.write(part.tobytes())
                file.write(bytes(-file.tell() % 8))
            file.write(bytes(8))
            file.flush()
            view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        parts = [np.frombuffer(view, kind, n, at) for at, kind, n in places]
        sequences = [EliasFano.back(parts[i : i + 4]) for i in range(0, len(parts) - 1, 4)]
        return Trie(list(zip(sequences[::2], sequences[1::2])), parts[-1])
