"""Groups that are kept up to date: only directories that changed are read and aggregated again.

A store has two Parquet tables, both appended to and never rewritten: ``states`` with one partial
aggregate per directory and signature (counts, sums, and for each "first" column the least order with its
value), and ``seen`` with the directories that a refresh covered, written last. A refresh that dies in
between leaves states that no row of ``seen`` names, and these are never read.

Groups are merged from the states that the current listing names by directory and fingerprint, so states
of directories that changed or are gone take no part. Merging gives the rows of ``grouping.group_series`` over
all series; rows without a directory are an error of the caller and not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators import grouping
from seriesloom.schema import BOOLEAN_KEYS, NUMERIC_KEYS, row_order, with_study

_STATES, _SEEN = "states", "seen"
_FIRST = ["series_id", "series_files", *grouping.FIRST_COLUMNS]


def group_states(series: DataFrame, null_keys: str = "drop") -> DataFrame:
    """Partial aggregates per ``directory, study`` and signature; they combine on the map side."""
    if null_keys not in ("drop", "keep"):
        raise ValueError("null_keys must be 'drop' or 'keep'")
    keys = grouping.available_keys(series)
    df = grouping.coerce_series(with_study(series))
    if null_keys == "drop":
        df = df.dropna(subset=[k for k in keys if k not in NUMERIC_KEYS + BOOLEAN_KEYS])
    order = row_order(df)

    def first(column: str):
        known = F.when(F.col(column).isNotNull(), order)
        return F.min_by(F.struct(order.alias("ord"), F.col(column).alias("value")), known)

    sums = [F.count("series_id").alias("n_series")]
    if "series_files" in df.columns:
        sums.append(F.coalesce(F.sum("series_files"), F.lit(0)).cast("bigint").alias("n_files"))
    return df.groupBy("directory", "study", *keys).agg(
        *sums, *[first(c).alias(f"first_{c}") for c in _FIRST if c in df.columns]
    )


def merged_groups(states: DataFrame) -> DataFrame:
    """Groups from states of any number of directories."""
    keys = grouping.available_keys(states)
    have = set(states.columns)

    def first(column: str, name: str | None = None):
        state = F.col(f"first_{column}")
        return F.min_by(state["value"], state["ord"]).alias(name or column)

    aggregates = [
        F.sum("n_series").alias("series_count"),
        first("series_id", "representative_series_id"),
    ]
    if "n_files" in have:
        aggregates += [F.sum("n_files").alias("total_files"), first("series_files", "representative_files")]
    aggregates += [first(c) for c in grouping.FIRST_COLUMNS if f"first_{c}" in have]
    return states.groupBy("study", *keys).agg(*aggregates).withColumn(
        "group_id", F.sha2(F.to_json(F.struct("study", *keys)), 256)
    )


def _seen(spark: SparkSession, store: str) -> DataFrame:
    """``directory, fingerprint, refresh``, one refresh for each pair; empty before the first."""
    columns = "directory string, fingerprint string, refresh string"
    try:
        rows = spark.read.schema(columns).parquet(f"{store}/{_SEEN}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], columns)
    return rows.groupBy("directory", "fingerprint").agg(F.min("refresh").alias("refresh"))


def refresh_groups(
    spark: SparkSession,
    store: str,
    listed: DataFrame,
    read: Callable[[DataFrame], DataFrame],
    null_keys: str = "drop",
) -> DataFrame:
    """Bring the store up to ``listed`` (``directory, fingerprint``) and return its groups.

    ``read`` gets the ``directory`` rows that have to be read and returns their series with a ``directory``
    column. ``listed`` is read several times, so pass a staged table. One refresh of a store at a time.
    Group columns must stay the same over the life of a store.
    """
    pairs = ["directory", "fingerprint"]
    listed = listed.where(F.col("directory").isNotNull()).select(*pairs).distinct()
    changed = listed.join(_seen(spark, store), pairs, "left_anti")
    refresh = uuid.uuid4().hex
    states = group_states(read(changed.select("directory")), null_keys)
    states.withColumn("refresh", F.lit(refresh)).write.partitionBy("refresh").mode("append").parquet(
        f"{store}/{_STATES}"
    )
    changed.withColumn("refresh", F.lit(refresh)).write.mode("append").parquet(f"{store}/{_SEEN}")
    current = listed.join(_seen(spark, store), pairs).select("directory", "refresh")
    kept = spark.read.schema(f"{_ddl(states)}, refresh string").parquet(f"{store}/{_STATES}")
    return merged_groups(kept.join(current, ["directory", "refresh"], "left_semi"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
