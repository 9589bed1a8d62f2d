"""Near copies for the pipeline: found by operator 7, decided by the exact similarity of word shingles.

Two texts are near copies if the Jaccard similarity of their sets of shingles is at least
``SIMILARITY``; equal texts (but for case and white space) are copies without a test. Components of
these links are the groups.

Candidates of operator 7. Every different text has its fingerprint, and the operator's covering tables link the
fingerprints within its radius; texts of one fingerprint, and the first texts of linked ones, are candidates.

Further candidates. At a similarity of 0.8 most fingerprints differ in more bits than that radius. So
that none of these is lost, each text has ``BANDS`` keys too, each of ``ROWS`` minima of independently multiplied shingle
hashes; texts that share a key meet in its bucket. Texts with a similarity ``s`` share none with
probability ``(1 - s ** 5) ** 30``: 7e-6 at 0.8, less above.

Decision. Every candidate is decided by the whole texts, never by its fingerprints or keys. First the
operator's links are tested, and each text of a bucket against one of its bucket. Then buckets that still hold several groups are tested pair by
pair, but for pairs that are in one group by then, so a text that is unlike the first one still finds
its copy.

Scale: equal texts collapse first. The first pass makes one row per text and bucket; texts travel only if they
share a bucket. The second pass deals large buckets into pairs of blocks of about ``BLOCK`` texts.

Defined results: null and empty texts and those without a word are equal to each other. A text of fewer
words than a shingle has one shingle, all its words. Shingles count as equal if their 64-bit
hashes are, texts if their 64-bit digests are. Null ids and repeated rows are as in operator 7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import simhash
from seriesloom.llm.common import packed, slices, whole_text
from seriesloom.llm.components import component_labels, stars
from seriesloom.llm.simhash import shingles, xxh64
from seriesloom.staging import stage

WORDS = 5
SIMILARITY = (4, 5)  # 0.8, as a fraction so that the comparison is exact
BANDS = 30
ROWS = 5
BLOCK = 512

_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_JOIN = np.uint64(0x9E3779B97F4A7C15)


def _texts(column: pa.Array) -> list[bytes]:
    offsets, data = packed(column)
    view = data.tobytes()
    return [view[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def digests(texts: list[bytes]) -> np.ndarray:
    """64-bit digest of each normalised text."""
    raw = [hashlib.blake2b(b" ".join(t.lower().split()), digest_size=8).digest() for t in texts]
    return np.frombuffer(b"".join(raw), np.int64)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    data, starts, sizes, count = shingles(texts, words)
    hashes = xxh64(data, starts, sizes) if len(starts) else np.zeros(0, np.uint64)
    return [np.unique(part) for part in np.split(hashes, np.cumsum(count)[:-1])]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """``BANDS`` bucket keys of each set; the sets are not empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    hashes, first = np.concatenate(sets), np.cumsum(sizes) - sizes
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = (key ^ np.minimum.reduceat(hashes * _FACTORS[k] + _TERMS[k], first)) * _JOIN
            key ^= key >> np.uint64(32)
        out[:, band] = key
    return out.view(np.int64)


def alike(shared: np.ndarray | int, one: np.ndarray | int, other: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of these sizes that share so many members are similar enough."""
    top, base = SIMILARITY
    return shared * base >= top * (one + other - shared)


def _print_table(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest, operator 7's fingerprint, number of shingles and bucket keys of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 19):
            texts = _texts(batch.column("text"))
            sets = shingle_sets(texts, words)
            number = np.array([len(s) for s in sets], np.int64)
            full = number > 0
            keys = band_keys([s for s in sets if len(s)]) if full.any() else np.zeros(0, np.int64)
            edges = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            columns = [
                batch.column("doc_id"),
                pa.array(digests(texts)),
                pa.array(simhash.fingerprints(texts).view(np.int64)),
                pa.array(number),
                pa.ListArray.from_arrays(pa.array(edges), pa.array(keys.ravel())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "sim", "n", "keys"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, fp bigint, sim bigint, n bigint, keys array<bigint>"
    )


def _digested(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the whole text with its digest, ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = pa.array(digests(_texts(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([values, *batch.columns], ["fp", *batch.schema.names])

    own = docs.select(*columns, whole_text().alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"fp bigint, {schema}")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp and text, one row for each digest of ``wanted`` (fp, first).

    Of the documents of a text only those with its first id are moved, however many hold it.
    """
    every = _digested(docs, "doc_id").alias("t")
    own = every.join(
        wanted.alias("w"), F.expr("t.fp = w.fp AND t.doc_id <=> w.first"), "left_semi"
    )
    return own.groupBy("fp").agg(F.min("text").alias("text"))


def similar(pairs: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a"):
            first, at = np.unique(np.asarray(batch.column("a")), return_index=True)
            known = _texts(batch.column("text_a").take(pa.array(at)))
            left = dict(zip(first.tolist(), shingle_sets(known, words)))
            right = shingle_sets(_texts(batch.column("text_b")), words)
            keep = []
            for a, y in zip(batch.column("a").to_pylist(), right):
                x = left[a]
                keep.append(bool(alike(len(np.intersect1d(x, y, True)), len(x), len(y))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (texts.select(F.col("fp").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a bigint, b bigint")


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b, of texts that operator 7 links, with their numbers of shingles.

    Each text with the first of its fingerprint, and the first texts of the fingerprints that span a component.
    """
    firsts = stage(
        distinct.groupBy("sim").agg(F.min(F.struct("fp", "n")).alias("text"), F.max("fp").alias("last")),
        "near-fingerprints",
    )
    shared = firsts.where("text.fp < last").select("sim", F.col("text").alias("x"))
    same = distinct.join(shared, "sim").where("fp <> x.fp").select("x", F.struct("fp", "n").alias("y"))
    links = simhash.fingerprint_links(firsts.select(F.col("sim").alias("fp"))).distinct()
    one, other = (firsts.select(F.col("sim").alias(c), F.col("text").alias(x)) for c, x in ("ax", "by"))
    across = links.join(one, "a").join(other, "b").select("x", "y")
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return same.unionByName(across).select(
        low["fp"].alias("a"), low["n"].alias("n_a"), high["fp"].alias("b"), high["n"].alias("n_b")
    )


def links_between(
    sets: list[np.ndarray], groups: list[int], blocks: list[int]
) -> list[tuple[int, int]]:
    """Links (index pairs) of similar sets that join different groups: all of one block, or those
    between two blocks."""
    sizes = np.array([len(s) for s in sets], np.int64)
    first = np.cumsum(sizes) - sizes
    members = np.unique(np.concatenate(sets), return_inverse=True)[1]
    group, block, links = np.array(groups, np.int64), np.array(blocks), []
    one = (block == block[0]).all()
    for x in range(len(sets)):
        untested = (group != group[x]) & (one | (block != block[x]))
        untested &= alike(np.minimum(sizes, sizes[x]), sizes, sizes[x])
        untested[: x + 1] = False
        if not untested.any():
            continue
        mine = np.zeros(members.max() + 1, bool)
        mine[members[first[x] : first[x] + sizes[x]]] = True
        shared = np.add.reduceat(mine[members], first, dtype=np.int64)
        for y in np.flatnonzero(untested & alike(shared, sizes, sizes[x])).tolist():
            if group[y] != group[x]:
                links.append((x, y))
                group[group == group[y]] = group[x]
    return links


def further_links(buckets: DataFrame, links: DataFrame, texts: DataFrame, words: int = WORDS) -> DataFrame:
    """Links (a, b) between texts of one bucket that ``links`` leave in different groups."""
    centres = stars(links).select(F.col("a").alias("fp"), F.col("b").alias("centre"))
    placed = buckets.join(centres, "fp", "left")
    placed = stage(placed.select("key", "fp", F.coalesce("centre", "fp").alias("group")), "near-placed")
    # Of buckets that hold the same texts, one is enough.
    mixed = (
        placed.groupBy("key")
        .agg(
            F.min("group").alias("low"),
            F.max("group").alias("high"),
            F.count("*").alias("size"),
            F.bit_xor(F.xxhash64("fp")).alias("x"),
            F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"),
        )
        .where("low < high")
        .groupBy("size", "x", "y")
        .agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    )
    dealt = (
        placed.join(mixed, "key")
        .withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("p", F.least("block", "other"))
        .withColumn("q", F.greatest("block", "other"))
        .join(texts, "fp")
        .select("key", "p", "q", "block", "group", "fp", "text")
    )

    def run(table: pa.Table) -> pa.Table:
        groups, found = table.column("group").to_pylist(), []
        if len(set(groups)) > 1:
            sets = shingle_sets(_texts(table.column("text")), words)
            found = links_between(sets, groups, table.column("block").to_pylist())
        pairs, fps = np.array(found, np.int64).reshape(-1, 2), np.asarray(table.column("fp"))
        return pa.table({"a": pa.array(fps[pairs[:, 0]]), "b": pa.array(fps[pairs[:, 1]])})

    return dealt.groupBy("key", "p", "q").applyInArrow(run, "a bigint, b bigint")


def _linked(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digests of all documents, the different ones with their first id, and links between these."""
    prints = stage(_print_table(docs, words), "near-prints")
    distinct = stage(
        prints.groupBy("fp").agg(
            F.min("doc_id").alias("first"),
            *[F.first(c).alias(c) for c in ("sim", "n", "keys")],
        ),
        "near-distinct",
    )
    near = fingerprint_pairs(distinct).where(alike(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b")))
    near = stage(near.select("a", "b"), "near-pairs")
    keyed = distinct.select("fp", "n", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(
        F.min(F.struct("fp", "n")).alias("centre"), F.max("fp").alias("last")
    )
    met = met.where("centre.fp < last").select(
        "key", F.col("centre.fp").alias("a"), F.col("centre.n").alias("n_a")
    )
    buckets = stage(keyed.join(met, "key"), "near-buckets")
    needed = buckets.select("fp").unionByName(near.select(F.explode(F.array("a", "b")).alias("fp")))
    wanted = distinct.join(needed.distinct(), "fp", "left_semi").select("fp", "first")
    texts = stage(_texts_of(docs, wanted), "near-texts")
    fits = alike(F.least("n", "n_a"), F.col("n"), F.col("n_a"))
    pairs = buckets.where((F.col("fp") != F.col("a")) & fits).select("a", F.col("fp").alias("b"))
    pairs = near.unionByName(pairs).distinct()
    links = stage(similar(pairs, texts, words), "near-links")
    links = links.unionByName(stage(further_links(buckets, links, texts, words), "near-links"))
    return prints, distinct, links


def components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and component_id (smallest id of its group) of every document."""
    prints, distinct, links = _linked(docs, words)
    labels = component_labels(distinct, "fp", "first", links)
    return prints.select("doc_id", "fp").join(labels, "fp").select(
        "doc_id", F.col("label").alias("component_id")
    )


def first_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of each group of near copies, all columns as they are.

    The row with the smallest id stays, null ids last; of rows with one id the text with the smallest
    digest, and of equal rows the smallest by all columns. Rows are told apart by id and
    text, so what happens to one row of an id says nothing about its other rows.
    """
    prints, distinct, links = _linked(docs, words)
    groups = component_labels(distinct.select("fp", F.col("fp").alias("own")), "fp", "own", links)
    kinds = prints.groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "n")
    chosen = stage(
        kinds.join(groups, "fp").groupBy("label").agg(F.min(order).alias("row")).select("row.*"),
        "near-chosen",
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    rows = _digested(rows, "doc_id", "row").drop("text").alias("t")

    def of(wanted: DataFrame) -> DataFrame:
        same = F.expr("t.fp = w.fp AND t.doc_id <=> w.doc_id")
        return rows.join(wanted.alias("w"), same, "left_semi")

    single = of(chosen.where("n = 1")).select("row.*")
    repeated = of(chosen.where("n > 1")).groupBy("doc_id", "fp").agg(F.min("row").alias("row"))
    return single.unionByName(repeated.select("row.*"))
