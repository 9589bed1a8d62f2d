"""Numbers that describe a data set before any grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriesloom.functions.coerce import to_number
from seriesloom.schema import row_order, with_study
from seriesloom.staging import stage


def overview(series: DataFrame) -> DataFrame:
    """One row per study: subjects, sessions, series, matrix sizes, ranges, motion split.

    Rows are first reduced per (subject, session, matrix size) with map-side combine, so the
    exact distinct counts expand that small table and not the series. A column that is absent
    counts as one subject or session, and leaves the other figures null.
    """
    df = with_study(series)
    have = set(df.columns)

    def raw(name: str):
        return F.col(name) if name in have else F.lit(None).cast("string")

    def number(name: str):
        return to_number(F.col(name)) if name in have else F.lit(None).cast("double")

    moco = (
        F.col("is_motion_corrected") if "is_motion_corrected" in have else F.lit(None)
    ).cast("boolean")
    reduced = df.groupBy(
        "study",
        raw("subject").alias("subject"),
        raw("session").alias("session"),
        raw("dim1").cast("string").alias("dim1"),
        raw("dim2").cast("string").alias("dim2"),
    ).agg(
        F.count("*").alias("n"),
        F.count_if(moco).alias("corrected"),
        F.count_if(~moco).alias("original"),
        *[
            pair
            for name in ("dim3", "dim4", "TR", "TE")
            for pair in (
                F.min(number(name)).alias(f"{name}_min"),
                F.max(number(name)).alias(f"{name}_max"),
            )
        ],
    )
    all_dims = {"dim1", "dim2", "dim3", "dim4"} <= have
    return reduced.groupBy("study").agg(
        (F.count_distinct("subject") if "subject" in have else F.lit(1)).alias("n_subjects"),
        (F.count_distinct("session") if "session" in have else F.lit(1)).alias("n_sessions"),
        F.sum("n").alias("n_series"),
        # A struct counts pairs that contain nulls; several columns would skip them.
        (F.count_distinct(F.struct("dim1", "dim2")) if all_dims else F.lit(None).cast("bigint"))
        .alias("n_matrix_sizes"),
        F.min("dim3_min").alias("dim3_min"),
        F.max("dim3_max").alias("dim3_max"),
        F.min("dim4_min").alias("dim4_min"),
        F.max("dim4_max").alias("dim4_max"),
        F.round(F.min("TR_min"), 1).alias("TR_min"),
        F.round(F.max("TR_max"), 1).alias("TR_max"),
        F.round(F.min("TE_min"), 1).alias("TE_min"),
        F.round(F.max("TE_max"), 1).alias("TE_max"),
        F.sum("original").alias("n_original"),
        F.sum("corrected").alias("n_motion_corrected"),
    )


def top_protocols(series: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent protocols per study, ties by first appearance.

    The counts are staged: both the ranking and the totals read them, the series are read once.
    """
    counts = stage(
        with_study(series)
        .where(F.col("protocol_name").isNotNull())
        .groupBy("study", "protocol_name")
        .agg(F.count("*").alias("n_series"), F.min(row_order(series)).alias("first_row")),
        "protocols",
    )
    totals = counts.groupBy("study").agg(F.count("*").alias("n_protocols"))
    order = W.partitionBy("study").orderBy(F.desc("n_series"), "first_row")
    # The rank filter right above the window keeps n rows per task before the shuffle.
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.join(totals, "study").select(
        "study",
        "rank",
        "protocol_name",
        "n_series",
        "n_protocols",
        F.greatest(F.col("n_protocols") - n, F.lit(0)).alias("n_more"),
    )


def series_total(series: DataFrame) -> DataFrame:
    """Distinct series ids per study, or rows where there is no id."""
    df = with_study(series)
    counted = F.count_distinct("series_id") if "series_id" in df.columns else F.count("*")
    return df.groupBy("study").agg(counted.alias("n_series"))
