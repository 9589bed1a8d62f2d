import pytest
from pyspark.sql import functions as F

from seriesloom.functions import coerce
from seriesloom.operators import grouping, profile
from seriesloom.plans import views

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = (
    "series_id string, row_ord bigint, protocol_name string, dim1 string, series_files bigint, "
    "example_dcm_file string, is_derived boolean"
)


def test_number_coercion(spark):
    cases = {
        "64": 64.0,
        " 64.5 ": 64.5,
        "1e3": 1000.0,
        ".5": 0.5,
        "5.": 5.0,
        "-3": -3.0,
        "inf": float("inf"),
        "-Infinity": float("-inf"),
        "1d": 0.0,
        "1f": 0.0,
        "NaN": 0.0,
        "bad": 0.0,
        "": 0.0,
        None: 0.0,
        "0x1A": 0.0,
        "1_000": 0.0,
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    rows = df.select("x", coerce.number_or_zero(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == cases


def test_numeric_columns_lose_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "x double")
    rows = df.select(coerce.numeric_or_zero(F.col("x"), "double")).collect()
    assert [r[0] for r in rows] == [0.0, 0.0, 2.0]


def test_missing_tokens(spark):
    df = spark.createDataFrame([("NA",), ("nan",), ("",), ("None",), ("none",), ("x",)], "x string")
    rows = df.select(coerce.blank_to_null(F.col("x"))).collect()
    assert [r[0] for r in rows] == [None, None, None, None, "none", "x"]


def test_groups_skip_nulls_per_column_and_keep_input_order(spark):
    rows = [
        ("b", 2, "T1", "64", None, "second", None),
        ("a", 1, "T1", "64.0", 5, None, False),
        ("c", 3, "T1", "bad", None, None, True),
        ("d", 4, None, "64", 9, "lost", False),
    ]
    series = spark.createDataFrame(rows, COLUMNS)
    groups = {r["dim1"]: r for r in grouping.group_series(series).collect()}
    assert set(groups) == {64.0, 0.0}
    first = groups[64.0]
    assert first["series_count"] == 2
    assert first["representative_series_id"] == "a"
    assert (first["total_files"], first["representative_files"]) == (5, 5)
    assert first["example_dcm_file"] == "second"
    # All files unknown still sums to zero.
    assert groups[0.0]["total_files"] == 0 and groups[0.0]["representative_files"] is None


def test_null_keys_can_be_kept(spark):
    series = views.series(spark, SF_DIR)
    dropped = grouping.coverage(grouping.group_series(series)).first()
    kept = grouping.coverage(grouping.group_series(series, null_keys="keep")).first()
    with_keys = series.dropna(subset=["sequence_name"]).count()
    assert dropped["n_series"] == with_keys
    assert kept["n_series"] == series.count()
    with pytest.raises(ValueError):
        grouping.group_series(series, null_keys="x")


def test_same_groups_for_any_partition_count(spark):
    def result(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        series = views.series(spark, SF_DIR).repartition(partitions)
        return sorted(map(tuple, grouping.group_series(series).collect()), key=str)

    try:
        one = result(1)
        assert one == result(4) == result(200)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_numbering_is_a_plain_row_number_within_each_study(spark):
    groups = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("study"),
        (F.col("id") % 7).alias("series_count"),
        F.sha2(F.col("id").cast("string"), 256).alias("group_id"),
    )
    numbered = grouping.number_groups(groups).toPandas()
    for _, study in numbered.groupby("study"):
        expected = study.sort_values(["series_count", "group_id"], ascending=[False, True])
        assert list(expected["group_no"]) == list(range(1, len(study) + 1))


def test_top_groups_report(spark):
    groups = grouping.group_series(views.series(spark, SF_DIR))
    top = grouping.top_groups(groups, 3).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3]
    assert top[0]["n_more"] == 862 - 3
    assert top[0]["dimensions"].count("x") == 2


def test_profile_of_the_documented_frame(spark):
    rows = [
        ("001", "001", "T1w_MPR", "256", "256", "176", "1", 2000.0, 30.0, False),
        ("001", "002", "T1w_MPR", "256", "256", "176", "1", 2000.0, 30.0, False),
        ("002", "001", "BOLD_REST", "64", None, "40", "200", 2500.0, 35.0, None),
    ]
    columns = (
        "subject string, session string, protocol_name string, dim1 string, dim2 string, "
        "dim3 string, dim4 string, TR double, TE double, is_motion_corrected boolean"
    )
    series = spark.createDataFrame(rows, columns).withColumn("row_ord", F.lit(1))
    row = profile.overview(series).first()
    assert (row["n_subjects"], row["n_sessions"], row["n_series"]) == (2, 2, 3)
    # A pair with a null is a pair.
    assert row["n_matrix_sizes"] == 2
    assert (row["dim3_min"], row["dim3_max"], row["TR_max"]) == (40.0, 176.0, 2500.0)
    # An unknown flag is in neither count.
    assert (row["n_original"], row["n_motion_corrected"]) == (2, 0)
    without = profile.overview(series.drop("subject", "session")).first()
    assert (without["n_subjects"], without["n_sessions"]) == (1, 1)
    top = profile.top_protocols(series, 1).first()
    assert (top["protocol_name"], top["n_series"], top["n_more"]) == ("T1w_MPR", 2, 1)
