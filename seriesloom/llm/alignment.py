"""Operator 11: alignment of two tokenizers over the same text, with corpus counts of token pairs.

A text with a space before it is encoded by a byte-level vocabulary (A) through its library's
character offsets and by a piece vocabulary (B) through the byte spans of its result. These spans are
coarse cuts: several A tokens may share one character, and of B's byte tokens for one character all
but the last have an empty span. Such tokens get their ends from the lengths of their decoded
bytes. Places where both sides end cut the tokens into groups; tokens that end there are linked.

Both vocabularies put a space only at the head of a token, so a text may be cut before each
single space between other characters and its pieces encoded apart (``_checked`` tests the B
vocabulary for this). A block of documents therefore encodes each of its different pieces once,
``AT_ONCE`` at a time, and a worker process keeps the tokens of up to ``KEPT_PIECES`` short pieces for its
later blocks (what it keeps changes no result). A block is up to ``BLOCK_BYTES`` of text, or one longer
text; what it holds bounds a task's memory.

Pair counts: a block lists its different pairs with counts; these are summed over blocks, compared
with the highest count of their B token (at most one row per B token, so that table is broadcast)
and joined back to the blocks' lists, which a document's pieces refer to. A pair that all
documents hold is one row per block, so no key is hot.

Defined results: null or empty texts, and those that a tokenizer does not give back byte by byte
(as with U+2581 in a text), have no tokens: zeros and an empty ``groups_sha256``; they count
nowhere. Equal rows each get their row and each count. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import slices
from seriesloom.staging import stage

VOCABULARY_A = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY_B = public_tokenizers.path("piece_bpe_32k.model")
BLOCK_BYTES = 8 << 20
AT_ONCE = 4_000
KEPT_PIECES = 250_000
KEPT_CHARS = 24
# Before a single space between characters that are not white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Encoder, and the decoded bytes of all ids end to end."""

    encoder: object
    starts: np.ndarray
    sizes: np.ndarray
    data: np.ndarray
    is_byte: np.ndarray  # the token is one byte of a character

    @classmethod
    def of(cls, encoder, tokens: list[bytes], is_byte: list[bool]) -> Vocabulary:
        sizes = np.array([len(t) for t in tokens], np.int64)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        return cls(encoder, np.cumsum(sizes) - sizes, sizes, data, np.array(is_byte, bool))

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0)
        return self.data[at + np.repeat(self.starts[ids] - (ends - sizes), sizes)]


@lru_cache(maxsize=2)
def byte_level(path: str) -> Vocabulary:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, processors

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    own.post_processor = processors.ByteLevel(trim_offsets=False)
    # Printable bytes stand for themselves, the others for 256 and on, in the order of the bytes.
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t.content for t in own.get_added_tokens_decoder().values()}
    tokens = [
        b"" if (t := own.id_to_token(i)) in special else bytes(byte_of[c] for c in t)
        for i in range(own.get_vocab_size())
    ]
    return Vocabulary.of(own, tokens, [len(t) == 1 and t[0] >= 128 for t in tokens])


def _checked(pieces: list[str]) -> list[str]:
    """The pieces, if none holds a space mark after another character."""
    wrong = [p for p in pieces if re.search(f"[^{_SPACE}]{_SPACE}", p)]
    if wrong:
        raise ValueError(f"texts cannot be cut at spaces with pieces such as {wrong[:3]}")
    return pieces


@lru_cache(maxsize=2)
def piece_level(path: str) -> Vocabulary:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    numbers = range(own.piece_size())
    pieces = _checked([own.id_to_piece(i) for i in numbers])
    hidden = [own.is_control(i) or own.is_unknown(i) or own.is_unused(i) for i in numbers]
    is_byte = [own.is_byte(i) for i in numbers]
    tokens = [
        b"" if off else bytes([int(p[3:5], 16)]) if byte else p.replace(_SPACE, " ").encode()
        for p, off, byte in zip(pieces, hidden, is_byte)
    ]
    return Vocabulary.of(own, tokens, is_byte)


@dataclass
class Tokens:
    """Tokens of texts that are joined end to end: ids, ends in bytes, tokens per text, and which
    texts came back byte by byte."""

    ids: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    whole: np.ndarray


def _refined(
    vocabulary: Vocabulary,
    ids: np.ndarray,
    coarse: np.ndarray,
    unsure: np.ndarray,
    counts: np.ndarray,
    raw: np.ndarray,
    text_ends: np.ndarray,
) -> Tokens:
    """Ends that a span gives, or that follow from the bytes of the tokens where spans are unsure.

    A text is whole if its tokens' bytes are its own; its spans must then agree with the bytes.
    """
    sizes = vocabulary.sizes[ids]
    first = np.concatenate([[0], np.cumsum(counts)])
    upto = np.concatenate([[0], np.cumsum(sizes)])
    text_starts = np.concatenate([[0], text_ends])[:-1]
    same_size = upto[first[1:]] - upto[first[:-1]] == text_ends - text_starts
    whole = same_size.copy()
    own = np.repeat(same_size, counts)
    data = vocabulary.decoded(ids[own])
    given = raw[np.repeat(same_size, text_ends - text_starts)]
    lengths = (text_ends - text_starts)[same_size]
    if (data != given).any():
        wrong = np.add.reduceat(data != given, np.cumsum(lengths) - lengths) > 0
        whole[np.flatnonzero(same_size)[wrong]] = False
    by_bytes = upto[1:] + np.repeat(text_starts - upto[first[:-1]], counts)
    ends = np.where(unsure, by_bytes, coarse)
    sound = np.repeat(whole, counts)
    if (ends != by_bytes)[sound].any():
        raise ValueError("spans and decoded bytes disagree")
    return Tokens(ids, ends, counts, whole)


def encode_a(texts: list[str], raw: np.ndarray, text_ends: np.ndarray, path: str) -> Tokens:
    """Texts (each with its leading space) by vocabulary A; ``raw`` is all of them in UTF-8."""
    vocabulary = byte_level(path)
    found = vocabulary.encoder.encode_batch(texts, add_special_tokens=False)
    counts = np.array([len(e) for e in found], np.int64)
    ids = np.fromiter((i for e in found for i in e.ids), np.int64, counts.sum())
    spans = np.array([s for e in found for s in e.offsets], np.int64).reshape(-1, 2)
    # Where characters start, to turn their numbers into bytes.
    places = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    characters = np.array([len(t) for t in texts], np.int64)
    base = np.repeat(np.cumsum(characters) - characters, counts)
    coarse = places[spans[:, 1] + base]
    starts = spans[:, 0] + base
    # The next token begins inside this token's last character.
    unsure = np.append(starts[1:] < (spans[:, 1] + base)[:-1], False)
    return _refined(vocabulary, ids, coarse, unsure, counts, raw, text_ends)


def encode_b(texts: list[str], raw: np.ndarray, text_ends: np.ndarray, path: str) -> Tokens:
    """The same texts by vocabulary B, which puts the leading space itself."""
    vocabulary = piece_level(path)
    found = vocabulary.encoder.encode([t[1:] for t in texts], return_type="proto", num_threads=1)
    rows = [(p.id, p.end) for e in found for p in e.pieces]
    counts = np.array([len(e.pieces) for e in found], np.int64)
    table = np.array(rows, np.int64).reshape(-1, 2)
    starts = np.concatenate([[0], text_ends])[:-1]
    coarse = table[:, 1] + 1 + np.repeat(starts, counts)
    unsure = vocabulary.is_byte[table[:, 0]]
    return _refined(vocabulary, table[:, 0], coarse, unsure, counts, raw, text_ends)


@dataclass
class Aligned:
    """Alignment of different pieces of text; per-piece arrays hold zeros where it is not whole."""

    whole: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_last: np.ndarray  # the token ends its group
    b_last: np.ndarray
    ends: np.ndarray  # bytes from the start of its piece, of each group


def align(pieces: list[str], path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> Aligned:
    """Tokens and groups of different pieces of text, each taken with a space before it."""
    texts = [" " + p for p in pieces]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    text_ends = np.cumsum([len(t.encode()) for t in texts]).astype(np.int64)
    a = encode_a(texts, raw, text_ends, path_a)
    b = encode_b(texts, raw, text_ends, path_b)
    whole = a.whole & b.whole
    keep_a, keep_b = np.repeat(whole, a.counts), np.repeat(whole, b.counts)
    a_ends, b_ends = a.ends[keep_a], b.ends[keep_b]
    a_last = np.isin(a_ends, b_ends, assume_unique=True, kind="sort")
    b_last = np.isin(b_ends, a_ends, assume_unique=True, kind="sort")
    n_a, n_b = a.counts * whole, b.counts * whole
    upto = np.concatenate([[0], np.cumsum(a_last)])
    edges = np.concatenate([[0], np.cumsum(n_a)])
    n_groups = upto[edges[1:]] - upto[edges[:-1]]
    starts = np.concatenate([[0], text_ends])[:-1]
    ends = a_ends[a_last] - np.repeat(starts, n_groups)
    return Aligned(whole, n_a, n_b, n_groups, a.ids[keep_a], b.ids[keep_b], a_last, b_last, ends)


def group_texts(found: Aligned) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each piece."""
    group_a = np.cumsum(found.a_last) - found.a_last
    group_b = np.cumsum(found.b_last) - found.b_last
    total = int(found.n_groups.sum())
    a_upto = np.cumsum(np.bincount(group_a, minlength=total))
    b_upto = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=total))])
    ids = np.empty(len(found.a) + len(found.b), np.int32)
    marks = np.empty(len(ids), np.uint8)
    place = np.arange(len(found.a)) + b_upto[group_a]
    ids[place], marks[place] = found.a, np.where(found.a_last, ord("|"), ord(","))
    place = np.arange(len(found.b)) + a_upto[group_b]
    ids[place], marks[place] = found.b, np.where(found.b_last, ord(";"), ord(","))
    width = 7
    powers = (10 ** np.arange(width - 1, -1, -1)).astype(np.int32)
    shown = np.empty((len(ids), width + 1), np.uint8)
    shown[:, :width] = ids[:, None] // powers % 10 + ord("0")
    shown[:, width] = marks
    used = np.ones(shown.shape, bool)
    used[:, : width - 1] = ids[:, None] >= powers[: width - 1]
    text = shown[used].tobytes()
    lengths = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    edges = lengths[np.concatenate([[0], np.cumsum(found.n_a + found.n_b)])]
    return [text[lo : max(lo, hi - 1)] for lo, hi in zip(edges[:-1], edges[1:])]


@lru_cache(maxsize=1)
def _kept(path_a: str, path_b: str) -> dict[str, bytes]:
    """Tokens of pieces that this process has aligned, as ``_bodies`` gives them."""
    return {}


def _bodies(found: Aligned) -> list[bytes]:
    """Each piece as 32-bit integers: twice the number of A tokens, plus one if it is whole; A tokens,
    then B tokens, each doubled, plus one if it ends its group."""
    sizes = 1 + found.n_a + found.n_b
    starts = np.cumsum(sizes) - sizes
    flat = np.empty(sizes.sum(), "<i4")
    flat[starts] = found.n_a * 2 + found.whole
    flat[_ranges(starts + 1, found.n_a)] = found.a * 2 + found.a_last
    flat[_ranges(starts + 1 + found.n_a, found.n_b)] = found.b * 2 + found.b_last
    raw = flat.tobytes()
    return [raw[4 * lo : 4 * (lo + n)] for lo, n in zip(starts.tolist(), sizes.tolist())]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def align_all(pieces: list[str], path_a: str, path_b: str) -> Aligned:
    """``align`` in bounded steps, without the ends, through what the process has kept."""
    kept = _kept(path_a, path_b)
    bodies = [kept.get(p) for p in pieces]
    new = [i for i, body in enumerate(bodies) if body is None]
    for at in range(0, len(new), AT_ONCE):
        step = new[at : at + AT_ONCE]
        for i, body in zip(step, _bodies(align([pieces[i] for i in step], path_a, path_b))):
            bodies[i] = body
            if len(kept) < KEPT_PIECES and len(pieces[i]) <= KEPT_CHARS:
                kept[pieces[i]] = body
    sizes = np.array([len(b) for b in bodies], np.int64) // 4
    flat = np.frombuffer(b"".join(bodies), "<i4").astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    head = flat[starts]
    n_a = head >> 1
    n_b = sizes - 1 - n_a
    a, b = flat[_ranges(starts + 1, n_a)], flat[_ranges(starts + 1 + n_a, n_b)]
    a_last, b_last = (a & 1).astype(bool), (b & 1).astype(bool)
    n_groups = _sums(a_last, n_a)
    return Aligned((head & 1).astype(bool), n_a, n_b, n_groups, a >> 1, b >> 1, a_last, b_last, head[:0])


def _pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Pieces per text, the number of each piece in order, and the different pieces."""
    known: dict[str, int] = {}
    codes = []
    for text in texts:
        cut = _CUT.split(text.as_py()) if text.is_valid and text.as_py() else []
        codes.append(np.fromiter((known.setdefault(p, len(known)) for p in cut), np.int64, len(cut)))
    counts = np.array([len(c) for c in codes], np.int64)
    return counts, np.concatenate([np.zeros(0, np.int64), *codes]), list(known)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    edges = np.concatenate([[0], np.cumsum(counts)])
    return upto[edges[1:]] - upto[edges[:-1]]


def alignments(
    docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B
) -> DataFrame:
    """The groups of every text: ids of both sides, tokens per group, and where groups end.

    Columns doc_id, a_ids, b_ids, a_sizes, b_sizes and ends (bytes of the text after its leading
    space, last one: its length plus one).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a_ids", "b_ids", "a_sizes", "b_sizes", "ends"]
        for batch in slices(batches):
            columns = {n: [] for n in names}
            for text in batch.column("text"):
                text = text.as_py() or ""
                found = align([text] if text else [], path_a, path_b)
                for name, values in zip(names, (
                    found.a,
                    found.b,
                    np.diff(np.flatnonzero(found.a_last), prepend=-1),
                    np.diff(np.flatnonzero(found.b_last), prepend=-1),
                    found.ends,
                )):
                    columns[name].append(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(columns[n], pa.list_(pa.int64())) for n in names]],
                ["doc_id", *names],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{n} array<bigint>" for n in ("a_ids", "b_ids", "a_sizes", "b_sizes", "ends"))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {lists}")


# --- blocks -----------------------------------------------------------------------------------

_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _block(batch: pa.RecordBatch, number: int, path_a: str, path_b: str) -> pa.RecordBatch:
    """One row per document and, last, one of the block: its pairs, and those of each piece."""
    counts, codes, different = _pieces(batch.column("text"))
    found = align_all(different, path_a, path_b)
    whole = _sums(~found.whole[codes], counts) == 0
    shown = group_texts(found)
    kept = codes[np.repeat(whole, counts)]
    kept_counts = counts * whole
    totals = {
        "n_a": _sums(found.n_a[kept], kept_counts),
        "n_b": _sums(found.n_b[kept], kept_counts),
        "n_groups": _sums(found.n_groups[kept], kept_counts),
    }
    totals["n_links"] = totals["n_groups"]
    edges = np.concatenate([[0], np.cumsum(kept_counts)])
    digests, own = [], []
    for lo, hi in zip(edges[:-1], edges[1:]):
        mine = kept[lo:hi]
        line = b";".join([shown[c] for c in mine])
        digests.append(hashlib.sha256(line).hexdigest() if len(mine) else "")
        own.append(mine.astype("<u4").tobytes())
    links = (found.a[found.a_last] << 32) | found.b[found.b_last]
    pairs, which = np.unique(links, return_inverse=True)
    often = np.bincount(kept, minlength=len(different))
    weight = np.bincount(which, np.repeat(often, found.n_groups), len(pairs)).astype(np.int64)
    n = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, number)),
            pa.array([False] * n + [True]),
            pa.concat_arrays([batch.column("doc_id"), pa.nulls(1, batch.column("doc_id").type)]),
            *[pa.array([*totals[c].tolist(), None], pa.int64()) for c in _COUNTS],
            pa.array([*digests, None], pa.string()),
            pa.array([*own, which.astype("<u4").tobytes()], pa.binary()),
            pa.array([*[None] * n, found.n_groups.astype("<u4").tobytes()], pa.binary()),
            pa.array([*[None] * n, pairs], pa.list_(pa.int64())),
            pa.array([*[None] * n, weight], pa.list_(pa.int64())),
        ],
        ["block", "is_block", "doc_id", *_COUNTS, "groups_sha256", "codes", "sizes", "pairs", "weights"],
    )


def _scored_block(documents: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over each document's links of their corpus counts, and how many are the best of B."""
    documents = documents.combine_chunks()
    is_block = documents["is_block"].to_numpy(zero_copy_only=False)
    head = documents.filter(pa.array(is_block))
    which = np.frombuffer(head["codes"][0].as_py(), "<u4")
    sizes = np.frombuffer(head["sizes"][0].as_py(), "<u4").astype(np.int64)
    count, best = np.zeros((2, max(1, answers.num_rows)), np.int64)
    at = answers["place"].to_numpy()
    count[at] = answers["total"].to_numpy()
    best[at] = answers["is_best"].to_numpy(zero_copy_only=False)
    of_piece = [_sums(values[which], sizes) for values in (count, best)]
    rows = documents.filter(pa.array(~is_block))
    own = [np.frombuffer(c.as_py(), "<u4") for c in rows["codes"]]
    lengths = np.array([len(c) for c in own], np.int64)
    codes = np.concatenate([np.zeros(0, np.uint32), *own])
    count_sum, n_best = (_sums(values[codes], lengths) for values in of_piece)
    return pa.table(
        {
            "doc_id": rows["doc_id"],
            **{c: rows[c] for c in _COUNTS},
            "n_best": pa.array(n_best),
            "count_sum": pa.array(count_sum),
            "groups_sha256": rows["groups_sha256"],
        }
    )


def aligned(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> DataFrame:
    """Per document: tokens of both sides, groups, links, and what the links count corpus-wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Unique in one run of the step; the written table fixes it for all that follows.
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, size=BLOCK_BYTES):
            yield _block(batch, number, path_a, path_b)
            number += 1

    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{c} bigint" for c in _COUNTS)
    blocks = stage(
        docs.select("doc_id", "text").mapInArrow(
            run,
            f"block bigint, is_block boolean, doc_id {id_type}, {columns}, groups_sha256 string, "
            "codes binary, sizes binary, pairs array<bigint>, weights array<bigint>",
        ),
        "aligned-blocks",
    )
    listed = (
        blocks.where("is_block")
        .select("block", F.posexplode(F.arrays_zip("pairs", "weights")).alias("place", "one"))
        .select("block", "place", F.col("one.pairs").alias("pair"), F.col("one.weights").alias("weight"))
    )
    totals = stage(listed.groupBy("pair").agg(F.sum("weight").alias("total")), "pair-counts")
    token = F.expr("pair & 4294967295").alias("b")
    highest = totals.groupBy(token).agg(F.max("total").alias("highest"))
    rated = totals.withColumn("b", token).join(F.broadcast(highest), "b").select(
        "pair", "total", (F.col("total") == F.col("highest")).alias("is_best")
    )
    answers = listed.join(rated, "pair").select(
        F.col("block").alias("of_block"), "place", "total", "is_best"
    )
    return (
        blocks.select("block", "is_block", "doc_id", *_COUNTS, "groups_sha256", "codes", "sizes")
        .groupBy("block")
        .cogroup(answers.groupBy("of_block"))
        .applyInArrow(
            _scored_block,
            f"doc_id {id_type}, {columns}, n_best bigint, count_sum bigint, groups_sha256 string",
        )
    )
