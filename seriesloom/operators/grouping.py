"""Grouping series by acquisition signature."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.functions.coerce import numeric_or_zero
from seriesloom.schema import BOOLEAN_KEYS, GROUP_KEYS, NUMERIC_KEYS, row_order, with_study

logger = logging.getLogger(__name__)

FIRST_COLUMNS = ["example_dcm_file", "dcm_dir_name", "subject", "session"]


def available_keys(series: DataFrame) -> list[str]:
    present = [k for k in GROUP_KEYS if k in series.columns]
    missing = [k for k in GROUP_KEYS if k not in series.columns]
    if missing:
        logger.warning("grouping without %s", ", ".join(missing))
    return present


def coerce_series(series: DataFrame) -> DataFrame:
    """Numbers that do not parse become 0, unset flags become false; other columns stay."""
    types = dict(series.dtypes)
    numbers = {
        c: numeric_or_zero(F.col(c), types[c]) for c in NUMERIC_KEYS if c in series.columns
    }
    flags = {
        c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
        for c in BOOLEAN_KEYS
        if c in series.columns
    }
    return series.withColumns({**numbers, **flags})


def group_series(series: DataFrame, null_keys: str = "drop") -> DataFrame:
    """One row per study and signature.

    ``null_keys='drop'`` leaves out series with an empty key, ``'keep'`` makes them groups of
    their own. "First" values are those of the lowest input order, each column skipping nulls,
    and carry through partial aggregation, so no row order has to survive a shuffle.
    """
    if null_keys not in ("drop", "keep"):
        raise ValueError("null_keys must be 'drop' or 'keep'")
    keys = available_keys(series)
    df = coerce_series(with_study(series))
    if null_keys == "drop":
        # Numbers and flags are never null any more.
        df = df.dropna(subset=[k for k in keys if k not in NUMERIC_KEYS + BOOLEAN_KEYS])
    order = row_order(df)

    def first(column: str):
        return F.min_by(column, F.when(F.col(column).isNotNull(), order))

    aggregates = [
        F.count("series_id").alias("series_count"),
        first("series_id").alias("representative_series_id"),
    ]
    if "series_files" in df.columns:
        aggregates += [
            F.coalesce(F.sum("series_files"), F.lit(0)).cast("bigint").alias("total_files"),
            first("series_files").alias("representative_files"),
        ]
    aggregates += [first(c).alias(c) for c in FIRST_COLUMNS if c in df.columns]
    grouped = df.groupBy("study", *keys).agg(*aggregates)
    return grouped.withColumn(
        "group_id", F.sha2(F.to_json(F.struct("study", *keys)), 256)
    )


def by_popularity(groups: DataFrame) -> DataFrame:
    """Most common groups first, in a total order."""
    return groups.orderBy("study", F.desc("series_count"), "group_id")


def number_groups(groups: DataFrame) -> DataFrame:
    """Add ``group_no``: 1, 2, … in popularity order within each study.

    One study may hold most groups, so no task may see a whole study. The order (count, then
    group id) is cut into slices by the first three hex digits of the id, which are evenly
    spread; slice sizes give each slice its offset and rows are numbered inside slices only.
    ``groups`` is read twice, so pass a staged table.
    """
    sliced = groups.withColumn("id_slice", F.substring("group_id", 1, 3))
    slice_sizes = sliced.groupBy("study", "series_count", "id_slice").agg(
        F.count("*").alias("slice_rows")
    )
    count_sizes = slice_sizes.groupBy("study", "series_count").agg(
        F.sum("slice_rows").alias("count_rows")
    )
    before = (W.unboundedPreceding, -1)
    # Distinct counts per study grow with the square root of its series at most.
    count_offsets = count_sizes.withColumn(
        "count_offset",
        F.coalesce(
            F.sum("count_rows").over(
                W.partitionBy("study").orderBy(F.desc("series_count")).rowsBetween(*before)
            ),
            F.lit(0),
        ),
    ).drop("count_rows")
    # At most 4096 slices per count.
    offsets = (
        slice_sizes.withColumn(
            "slice_offset",
            F.coalesce(
                F.sum("slice_rows").over(
                    W.partitionBy("study", "series_count")
                    .orderBy("id_slice")
                    .rowsBetween(*before)
                ),
                F.lit(0),
            ),
        )
        .join(count_offsets, ["study", "series_count"])
        .select(
            "study",
            "series_count",
            "id_slice",
            (F.col("count_offset") + F.col("slice_offset")).alias("offset"),
        )
    )
    in_slice = W.partitionBy("study", "series_count", "id_slice").orderBy("group_id")
    numbered = sliced.withColumn("in_slice", F.row_number().over(in_slice))
    return numbered.join(offsets, ["study", "series_count", "id_slice"]).select(
        *groups.columns, (F.col("offset") + F.col("in_slice")).cast("bigint").alias("group_no")
    )


def coverage(groups: DataFrame) -> DataFrame:
    """Number of groups and of series in them, per study."""
    return groups.groupBy("study").agg(
        F.count("*").alias("n_groups"), F.sum("series_count").alias("n_series")
    )


def top_groups(groups: DataFrame, n: int = 10) -> DataFrame:
    """Report rows of the ``n`` most common groups of each study."""
    order = W.partitionBy("study").orderBy(F.desc("series_count"), "group_id")
    ranked = groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    totals = coverage(groups).select("study", "n_groups")

    def text(name: str):
        value = F.col(name).cast("string") if name in groups.columns else F.lit(None)
        return F.coalesce(value, F.lit("Unknown"))

    def dim(name: str):
        return F.col(name).cast("string") if name in groups.columns else F.lit("0")

    return ranked.join(totals, "study").select(
        "study",
        "rank",
        "series_count",
        text("protocol_name").alias("protocol"),
        text("series_description").alias("description"),
        F.concat_ws("x", dim("dim1"), dim("dim2"), dim("dim3")).alias("dimensions"),
        F.greatest(F.col("n_groups") - n, F.lit(0)).alias("n_more"),
    )
