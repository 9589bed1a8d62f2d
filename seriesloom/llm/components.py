"""Connected components of links in shared storage, with the smallest value as label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.staging import stage


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars that span the links of one partition: (node, smallest node it reaches here)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    if parent:
        nodes = np.fromiter((x for x in parent if root(x) != x), np.int64)
        tops = np.fromiter((root(int(x)) for x in nodes), np.int64, len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(tops)], ["a", "b"])


def stars(links: DataFrame) -> DataFrame:
    """Links (a, b) as stars (node, centre): every node of a component of two or more points to
    its smallest node.

    Alternates two steps until nothing changes, each a grouping on one end: every node connects
    its larger neighbours to its smallest one, then its smaller neighbours and itself to the
    smallest. A task first reduces its own links to a spanning forest, so the rows handled are at
    most the links of the input and fall quickly. Each round is written to shared storage.
    """
    edges = stage(links.mapInArrow(_spanning, "a bigint, b bigint").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Larger neighbours to the smallest of the neighbourhood.
        large = (
            both.where("b > a")
            .join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        large = stage(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        small = stage(small, "links")
        same = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = small
        if tuple(same) == tuple(now):
            return edges


def component_labels(nodes: DataFrame, node: str, value: str, links: DataFrame) -> DataFrame:
    """Columns ``node`` and ``label``: the smallest ``value`` in the component of each node.

    ``nodes`` has one row per node; links join nodes by their bigint ids.
    """
    centres = stars(links).select(F.col("a").alias("_node"), F.col("b").alias("_centre"))
    placed = nodes.join(centres, nodes[node] == centres["_node"], "left").select(
        nodes[node], nodes[value].alias("_value"), F.coalesce("_centre", nodes[node]).alias("_centre")
    )
    labels = placed.groupBy("_centre").agg(F.min("_value").alias("label"))
    return placed.join(labels, "_centre").select(node, "label")
