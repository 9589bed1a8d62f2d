"""Column names and types shared by every step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The attributes that make two series "the same acquisition".
GROUP_KEYS = [
    "protocol_name",
    "series_description",
    "sequence_name",
    "dim1",
    "dim2",
    "dim3",
    "dim4",
    "TR",
    "TE",
    "is_derived",
    "is_motion_corrected",
    "image_type",
]
NUMERIC_KEYS = ["dim1", "dim2", "dim3", "dim4", "TR", "TE"]
BOOLEAN_KEYS = ["is_motion_corrected", "is_derived"]
TEXT_KEYS = ["protocol_name", "series_description", "sequence_name", "image_type"]

# Columns of the result when there is nothing to read.
EMPTY_COLUMNS = [
    "total_files_till_now",
    "example_dcm_file",
    "series_id",
    "dcm_dir_name",
    "dim1",
    "dim2",
    "dim3",
    "dim4",
    "TR",
    "TE",
    "protocol_name",
    "is_motion_corrected",
    "series_description",
]

SERIES_SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("session", T.StringType()),
        T.StructField("protocol_name", T.StringType()),
        T.StructField("series_description", T.StringType()),
        T.StructField("sequence_name", T.StringType()),
        T.StructField("dim1", T.StringType()),
        T.StructField("dim2", T.StringType()),
        T.StructField("dim3", T.StringType()),
        T.StructField("dim4", T.StringType()),
        T.StructField("TR", T.DoubleType()),
        T.StructField("TE", T.DoubleType()),
        T.StructField("is_derived", T.BooleanType()),
        T.StructField("is_motion_corrected", T.BooleanType()),
        T.StructField("image_type", T.StringType()),
        T.StructField("series_files", T.LongType()),
        T.StructField("example_dcm_file", T.StringType()),
        T.StructField("dcm_dir_name", T.StringType()),
        T.StructField("total_files_till_now", T.LongType()),
    ]
)

DEFAULT_STUDY = "study"


def with_study(df: DataFrame) -> DataFrame:
    """A table without a ``study`` column is one study; rows without a study join it."""
    if "study" in df.columns:
        return df.withColumn("study", F.coalesce("study", F.lit(DEFAULT_STUDY)))
    return df.withColumn("study", F.lit(DEFAULT_STUDY))


def row_order(df: DataFrame) -> Column:
    """What stands for input order: ``row_ord``, else a total order over what tells series apart.

    Series ids repeat over sessions and are text, so the number comes first and further columns
    decide; only rows that agree in all of them are tied, and those are interchangeable.
    """
    if "row_ord" in df.columns:
        return F.col("row_ord")
    further = ["subject", "session", "dcm_dir_name", "example_dcm_file", "series_files"]
    return F.struct(
        F.col("series_id").cast("string").try_cast("double").alias("number"),
        F.col("series_id").cast("string").alias("id"),
        *[F.col(c) for c in further if c in df.columns],
    )
