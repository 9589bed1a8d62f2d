"""Rule matches as lists: the series of each key in input order, in chunks of bounded length.

One list per key would put all series of a popular key in one task. Matches are therefore sorted by range
over all tasks, a key's rows may span many of them, and their sizes give each task its offset in
the key's list. No step sees more rows of a key than one task of the sort, or one chunk.

Rows are moved once, by that sort. Each task of it writes runs of at most a chunk, and only these are moved further.
Keys that ask for the same have the same list; ``shared_lists`` gives it to all of them when it is complete.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.operators.skew import grid_join
from seriesloom.schema import with_study
from seriesloom.staging import stage

CHUNK = 1000
# Chunks, or keys, of one shared list that meet in a task.
CELL = 1000
_KEY = ["study", "key_name"]


def _runs(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition as runs of one key: at most ``chunk`` ids, and their place in the partition."""
    last, before = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in _KEY]
        firsts = np.flatnonzero(np.append(True, np.any([np.diff(c) != 0 for c in codes], axis=0)))
        ends = np.append(firsts[1:], batch.num_rows)
        cuts = np.concatenate([np.arange(a, b, chunk) for a, b in zip(firsts, ends)])
        start = cuts - np.repeat(firsts, -(-(ends - firsts) // chunk))
        # The first key may go on from the batch before.
        if (key := [batch.column(c)[0].as_py() for c in _KEY]) == last:
            start[cuts < ends[0]] += before
        else:
            before = 0
        last = [batch.column(c)[-1].as_py() for c in _KEY]
        before = int(ends[-1] - firsts[-1]) + (before if len(firsts) == 1 and key == last else 0)
        edges = pa.array(np.append(cuts, batch.num_rows), pa.int32())
        at = pa.array(cuts)
        columns = [batch.column(c).take(at) for c in [*_KEY, "part"]]
        columns += [pa.array(start, pa.int64()), pa.ListArray.from_arrays(edges, batch.column("series_id"))]
        yield pa.RecordBatch.from_arrays(columns, [*_KEY, "part", "start", "ids"])


def posting_lists(matches: DataFrame, keys: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``study, key_name, chunk, ids``: chunk 0, 1, … of each key, all but the last with ``chunk`` ids.

    ``matches`` is what ``rules.apply_rules`` gives. Order is ``row_ord``, nulls first, then ``series_id``; repeated
    matches stay. Keys of ``keys`` without a match have one empty chunk.
    """
    if chunk < 1:
        raise ValueError("chunk must be at least 1")
    order = [c for c in ("row_ord", "series_id") if c in matches.columns]
    rows = with_study(matches).select(*_KEY, *order)
    spread = rows.repartitionByRange(*_KEY, *order).sortWithinPartitions(*_KEY, *order)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    # The written table fixes which task a row was in.
    runs = stage(
        spread.select(*_KEY, F.spark_partition_id().alias("part"), "series_id").mapInArrow(
            lambda batches: _runs(batches, chunk),
            f"study {types['study']}, key_name {types['key_name']}, part int, start bigint, "
            f"ids array<{types['series_id']}>",
        ),
        "postings",
    )
    sizes = runs.groupBy(*_KEY, "part").agg(F.sum(F.size("ids")).alias("n"))
    # At most one row per key and task of the sort.
    before = W.partitionBy(*_KEY).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*_KEY, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = runs.join(offsets, [*_KEY, "part"]).withColumn("place", F.col("offset") + F.col("start"))
    first, last = F.col("place"), F.col("place") + F.size("ids") - 1
    low, high = (F.floor(x / chunk).cast("bigint") for x in (first, last))
    # A run is no longer than a chunk, so it lies in two at most.
    cut = placed.withColumn("chunk", F.explode(F.sequence(low, high)))
    skipped = F.greatest(F.col("chunk") * chunk - F.col("place"), F.lit(0)).cast("int")
    part = F.when(
        F.col("chunk") * chunk > F.col("place"), F.slice("ids", skipped + 1, F.size("ids"))
    ).otherwise(F.slice("ids", F.lit(1), ((F.col("chunk") + 1) * chunk - F.col("place")).cast("int")))
    entry = F.struct("place", part.alias("ids"))
    lists = cut.groupBy(*_KEY, "chunk").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    filled = lists.select(*_KEY, "chunk", F.flatten("entries.ids").alias("ids"))
    empty = (
        with_study(keys)
        .select(*_KEY)
        .distinct()
        .join(sizes.select(*_KEY).distinct(), _KEY, "left_anti")
        .select(*_KEY, F.lit(0).cast("bigint").alias("chunk"), F.array().cast(filled.schema["ids"].dataType).alias("ids"))
    )
    return filled.unionByName(empty)


def shared_lists(lists: DataFrame, shared: DataFrame, cell: int = CELL) -> DataFrame:
    """The lists of all keys of ``shared`` (``rules.shared_keys``), given those of its shared keys."""
    own = stage(lists.withColumnRenamed("key_name", "shared_key"), "shared-lists")
    return grid_join(own, shared, ["study", "shared_key"], cell).select(*_KEY, "chunk", "ids")


def listed_matches(lists: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``study, key_name, position, series_id``, positions from 1; nulls for a key without a match."""
    entries = lists.select(*_KEY, "chunk", F.posexplode_outer("ids").alias("i", "series_id"))
    return entries.select(
        *_KEY, (F.col("chunk") * chunk + F.col("i") + 1).cast("bigint").alias("position"), "series_id"
    )
