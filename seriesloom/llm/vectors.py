"""Operator 8: near-duplicate vectors by product quantisation, with an exact rerank.

A coarse quantiser cuts each label's vectors into inverted lists; what is left of a vector after
its list's centre is coded per subspace. A query meets a list's codes through one table of
distances per subspace (asymmetric: the query is not coded), and only vectors whose table distance
could belong to a link are compared exactly, as cosines in double precision.

Which links are found: (1) A vector within distance ``d`` of a query can be in the list of centre
``c`` only if the query is no further than ``d`` from the plane between ``c`` and its own centre ``o``,
``(|q-c|^2 - |q-o|^2) / (2 |c-o|) <= d``. All such lists are probed, so
both ends of a link find it; a ``probe_reach`` below 1 probes those within this share of ``d``, which is
cheaper and may count a link at one end only. (2) The error of each code is
stored as a norm, so a table distance is off by no more than it; the filter keeps every row within
``d`` plus its error. (3) The rerank decides alone, in double precision. Each vector
counts the links it finds itself.

Scale: equal vectors of a label are one row with a count, so copies cost nothing. A list is
split into blocks of about ``BLOCK`` vectors and its queries into parts; each pair of block and part
is one visit, so no task grows with a list. A visit returns counts and spanning links, never all
pairs. The number of lists grows with the square root of the rows. Centres and code books
are fitted on a bounded sample, and their size does not depend on the data.

Defined results: vectors that are null, empty, zero, or hold null or non-finite numbers link with
nothing, nor do rows without a label; they get 0 links and their own id. Vectors of different
lengths never link. Equal rows count as links of each other; rows that share an id are rows of
their own. Other columns are not read. A null id gets null as component when unlinked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.components import component_labels
from seriesloom.staging import stage

THRESHOLD = 0.98
PROBE_REACH = 1.0
LEAST_LISTS, MOST_LISTS = 8, 4096
SUBSPACES = 8
CODES = 64
SAMPLE = 8000
BLOCK = 2048
SLACK = 1e-6


# --- quantisers --------------------------------------------------------------------------------


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres."""
    return np.maximum(
        (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :], 0
    )


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """At most ``k`` centres; empty ones are left where they were."""
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(points, centres).argmin(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return np.unique(centres, axis=0)


@dataclass
class Quantiser:
    """Coarse centres and, per subspace, the centres of the residuals."""

    centres: np.ndarray
    books: list[np.ndarray]

    def spans(self) -> list[slice]:
        edges = np.cumsum([0, *[b.shape[1] for b in self.books]])
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]

    def home(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centres).argmin(1)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the norm of what the codes leave."""
        rest = x - self.centres[home]
        codes, error = [], np.zeros(len(x))
        for span, book in zip(self.spans(), self.books):
            code = _nearest(rest[:, span], book).argmin(1)
            error += ((rest[:, span] - book[code]) ** 2).sum(1)
            codes.append(code)
        return np.stack(codes, 1).astype(np.uint8), np.sqrt(error)

    def probes(self, x: np.ndarray, home: np.ndarray, reach: float) -> np.ndarray:
        """Which lists (columns) can hold a vector within ``reach`` of each query (rows)."""
        square = _nearest(x, self.centres)
        apart = np.sqrt(_nearest(self.centres, self.centres))
        own = square[np.arange(len(x)), home][:, None]
        gap = np.maximum(apart[home], 1e-12)
        found = (square - own) / (2 * gap) <= reach + SLACK
        found[np.arange(len(x)), home] = True
        return found

    def table_distances(self, query: np.ndarray, list_id: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries (rows) to coded vectors (columns) of one list, by table look-up."""
        rest = query - self.centres[list_id]
        total = np.zeros((len(query), len(codes)), np.float32)
        for k, (span, book) in enumerate(zip(self.spans(), self.books)):
            total += _nearest(rest[:, span], book).astype(np.float32)[:, codes[:, k]]
        return np.sqrt(total)


def fit(sample: np.ndarray, lists: int = 16, subspaces: int = SUBSPACES, codes: int = CODES) -> Quantiser:
    """Quantiser of unit vectors, fitted on a sample."""
    centres = kmeans(sample, lists)
    rest = sample - centres[_nearest(sample, centres).argmin(1)]
    parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
    return Quantiser(centres, [kmeans(rest[:, p], codes) for p in parts])


# --- links -----------------------------------------------------------------------------------


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, also where squares would overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten()).astype(np.float64)
    return unit(values.reshape(len(column), -1))


def link_blocks(
    quantiser: Quantiser,
    queries: tuple[np.ndarray, np.ndarray],
    stored: tuple[np.ndarray, np.ndarray, np.ndarray],
    list_id: int,
    threshold: float,
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of each query the number of stored vectors it links with (as many as they count), and links
    (query id, stored id) that span the components of this visit."""
    ids, x = queries
    known, y, weight = stored
    reach = np.sqrt(2 - 2 * threshold)
    codes, error = quantiser.encode(y, np.full(len(y), list_id))
    counts, links = np.zeros(len(ids), np.int64), []
    seen: dict[int, int] = {}

    def root(a: int) -> int:
        while seen.setdefault(a, a) != a:
            a = seen[a]
        return a

    for lo in range(0, len(ids), 512):
        near = quantiser.table_distances(x[lo : lo + 512], list_id, codes)
        near = near <= (reach + error)[None, :] + 1e-4
        rows, cols = np.nonzero(near)
        if not len(rows):
            continue
        # Exact rerank of what the tables let through.
        cosine = np.concatenate(
            [
                np.einsum("ij,ij->i", x[lo + rows[a : a + 65536]], y[cols[a : a + 65536]])
                for a in range(0, len(rows), 65536)
            ]
        )
        linked = (cosine >= threshold) & (ids[lo + rows] != known[cols])
        rows, cols = rows[linked], cols[linked]
        counts += np.bincount(lo + rows, weight[cols], len(ids)).astype(np.int64)
        # Each query once with its first partner, then partners among themselves through it.
        for r, c in zip((lo + rows).tolist(), cols.tolist()):
            a, b = root(int(ids[r])), root(int(known[c]))
            if a != b:
                seen[max(a, b)] = min(a, b)
                links.append((int(ids[r]), int(known[c])))
    return counts, links


def _sound(vector: str) -> F.Column:
    """Whether a vector is there, whole, finite and not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce(
        v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda e: e != 0), F.lit(False)
    )


def near_duplicates(
    table: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    probe_reach: float = PROBE_REACH,
) -> DataFrame:
    """key, n_links, component_id and kept of every row of ``table``."""
    rows = table.select(
        F.col(key).alias("_key"), F.col(vector).alias("_vector"), F.col(label).alias("_label")
    ).withColumn("_sound", _sound("_vector") & F.col("_label").isNotNull())
    # A label's equal vectors share a 64-bit name; they are one row from here on.
    name = F.xxhash64("_label", "_vector")
    marked = rows.withColumn("_node", F.when(F.col("_sound"), name))
    slim = stage(marked.select("_key", "_node"), "vector-keys")
    distinct = stage(
        marked.where("_sound")
        .groupBy("_node")
        .agg(
            F.count("*").alias("n"),
            F.min("_key").alias("first"),
            F.first("_vector").alias("vector"),
            F.first("_label").cast("string").alias("label"),
        )
        .withColumn("width", F.size("vector")),
        "vectors",
    )
    widths = {r["width"]: r["count"] for r in distinct.groupBy("width").count().limit(65).collect()}
    if len(widths) > 64:
        raise ValueError("vectors of more than 64 different lengths")
    quantisers = {}
    for width in sorted(widths):
        sample = (
            distinct.where(F.col("width") == width)
            .orderBy(F.xxhash64("_node", F.lit(1)))
            .limit(max(SAMPLE, 16 * MOST_LISTS if widths[width] > 1 << 24 else 0))
            .select("vector")
        )
        lists = max(LEAST_LISTS, min(MOST_LISTS, int(widths[width] ** 0.5 / 14)))
        vectors = np.array([r[0] for r in sample.toLocalIterator()], np.float64)
        quantisers[width] = fit(unit(vectors), lists)
    visits = _visits(distinct, quantisers, threshold, probe_reach)
    found = stage(_visited(visits, quantisers, threshold), "vector-links")
    counts = found.groupBy("a").agg(F.sum("n").alias("linked"))
    labels = component_labels(
        distinct.select("_node", "first"), "_node", "first", found.where("b IS NOT NULL").select("a", "b")
    )
    per_node = (
        distinct.select("_node", "n")
        .join(labels, "_node")
        .join(counts, F.col("_node") == F.col("a"), "left")
        .select("_node", "label", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"))
    )
    joined = slim.join(per_node, "_node", "left")
    component = F.coalesce("label", "_key")
    return joined.select(
        F.col("_key").alias(key),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (F.col("_key") == component).alias("kept"),
    )


def _visits(
    distinct: DataFrame, quantisers: dict[int, Quantiser], threshold: float, probe_reach: float
) -> DataFrame:
    """Each vector as stored row of its list's block, for every part of the list's queries, and as
    query of every block of every list that it probes. Blocks and parts are slices by hash.
    """
    reach = float(np.sqrt(2 - 2 * threshold)) * probe_reach

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.asarray(batch.column("width"))
            home = np.zeros(batch.num_rows, np.int32)
            probed: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                q = quantisers[int(width)]
                x = _matrix(batch.column("vector").take(pa.array(at)))
                own = q.home(x)
                home[at] = own
                for i, row in zip(at, q.probes(x, own, reach)):
                    probed[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in ("_node", "n", "vector", "label", "width")],
                    pa.array(home),
                    pa.array(probed, pa.list_(pa.int32())),
                ],
                ["_node", "n", "vector", "label", "width", "home", "probed"],
            )

    schema = "_node bigint, n bigint, vector array<{}>, label string, width int, home int, probed array<int>"
    kind = distinct.schema["vector"].dataType.elementType.simpleString()
    placed = stage(
        distinct.select("_node", "n", "vector", "label", "width").mapInArrow(homes, schema.format(kind)),
        "vector-lists",
    )
    probing = placed.select("label", "width", F.explode("probed").alias("list"), F.lit(0).alias("own"))
    holding = placed.select("label", "width", F.col("home").alias("list"), F.lit(1).alias("own"))
    sizes = (
        probing.unionByName(holding)
        .groupBy("label", "width", "list")
        .agg(
            F.greatest(F.ceil(F.sum("own") / BLOCK), F.lit(1)).cast("int").alias("blocks"),
            F.greatest(F.ceil(F.sum(1 - F.col("own")) / (2 * BLOCK)), F.lit(1)).cast("int").alias("parts"),
        )
    )

    def slice_of(count: str, salt: int) -> F.Column:
        return F.pmod(F.xxhash64("_node", F.lit(salt)), F.col(count)).cast("int")

    def every(count: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    keys, held = ["label", "width", "list"], ["_node", "n", "vector"]
    stored = placed.withColumnRenamed("home", "list").join(sizes, keys).select(
        *keys, slice_of("blocks", 2).alias("block"), every("parts").alias("part"), *held,
        F.lit(True).alias("is_stored"),
    )
    queries = placed.withColumn("list", F.explode("probed")).join(sizes, keys).select(
        *keys, every("blocks").alias("block"), slice_of("parts", 3).alias("part"), *held,
        F.lit(False).alias("is_stored"),
    )
    return stored.unionByName(queries)


def _visited(visits: DataFrame, quantisers: dict[int, Quantiser], threshold: float) -> DataFrame:
    """Rows (a, n, null): a's links found in a visit; and (a, 0, b): spanning links."""
    keys = ["label", "width", "list", "block", "part"]
    ordered = visits.repartition(*keys).sortWithinPartitions(*keys, F.col("is_stored").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, stored = None, None

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            kinds = np.asarray(batch.column("is_stored").cast(pa.uint8())) > 0
            ids = np.asarray(batch.column("_node"))
            weights = np.asarray(batch.column("n"))
            groups = list(zip(*columns))
            cuts = [i for i in range(1, len(groups)) if groups[i] != groups[i - 1] or kinds[i] != kinds[i - 1]]
            for lo, hi in zip([0, *cuts], [*cuts, len(groups)]):
                if lo == hi:
                    continue
                x = _matrix(batch.column("vector").slice(lo, hi - lo))
                if groups[lo] != held_key:
                    held_key, stored = groups[lo], None
                if kinds[lo]:
                    new = (ids[lo:hi], x, weights[lo:hi])
                    stored = new if stored is None else tuple(map(np.concatenate, zip(stored, new)))
                    continue
                if stored is None:
                    continue
                q = quantisers[groups[lo][1]]
                counts, links = link_blocks(q, (ids[lo:hi], x), stored, groups[lo][2], threshold)
                some = np.flatnonzero(counts)
                a = np.concatenate([ids[lo:hi][some], np.array([p[0] for p in links], np.int64)])
                n = np.concatenate([counts[some], np.zeros(len(links), np.int64)])
                b = [None] * len(some) + [p[1] for p in links]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64())],
                    ["a", "n", "b"],
                )

    return ordered.mapInArrow(run, "a bigint, n bigint, b bigint")
