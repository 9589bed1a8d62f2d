"""Groups brought up to date equal groups built anew, and only changed directories are read."""

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import grouping, incremental

COLUMNS = (
    "directory string, study string, row_ord bigint, series_id string, protocol_name string, TR double, "
    "is_derived boolean, image_type string, series_files bigint, subject string, dcm_dir_name string"
)


def rows_of(directory, numbers, step=1):
    return [
        (
            directory,
            "a" if n % 2 else None,
            n * step,
            None if n % 9 == 0 else f"s{n}",
            [None, "p", "q"][n % 3],
            [None, 1.5, float("nan")][n % 3 - 1],
            [None, True][n % 2],
            "x",
            None if n % 4 == 0 else n,
            None if n % 5 else f"u{n}",
            directory,
        )
        for n in numbers
    ]


def listed(spark, pairs):
    return spark.createDataFrame(pairs, "directory string, fingerprint string")


@pytest.mark.parametrize("null_keys", ["drop", "keep"])
def test_refreshed_groups_equal_a_full_rebuild(spark, tmp_path, null_keys):
    store, asked = str(tmp_path / "store"), []
    states = [
        {"a": ("1", range(20)), "b": ("1", range(20, 40)), "c": ("1", range(-30, 0)), "e": ("1", [3, 6])},
        {"a": ("1", range(20)), "b": ("2", range(-9, 31)), "d": ("1", range(50, 60)), "e": ("1", [3, 6])},
        {"a": ("1", range(20)), "b": ("2", range(-9, 31)), "d": ("1", range(50, 60)), "e": ("1", [3, 6])},
        # Back to an earlier state: nothing is read.
        {"a": ("1", range(20)), "b": ("1", range(20, 40))},
        {},
    ]
    for tree in states:
        rows = [row for name, (_, numbers) in tree.items() for row in rows_of(name, numbers)]
        series = spark.createDataFrame(rows, COLUMNS)

        def read(changed, series=series):
            asked.append(sorted(r.directory for r in changed.collect()))
            return series.join(changed, "directory", "left_semi")

        now = listed(spark, [(name, mark) for name, (mark, _) in tree.items()] * 2 + [(None, "x")])
        groups = incremental.refresh_groups(spark, store, now, read, null_keys)
        full = grouping.group_series(series.drop("directory"), null_keys)
        assert groups.columns == full.columns
        assert sorted(map(str, groups.collect())) == sorted(map(str, full.collect()))
    # A directory without any group is not read twice.
    assert asked == [["a", "b", "c", "e"], ["b", "d"], [], [], []]


def test_an_interrupted_refresh_leaves_nothing_behind(spark, tmp_path):
    store = str(tmp_path / "store")
    series = spark.createDataFrame(rows_of("a", range(20)), COLUMNS)
    half = incremental.group_states(series).withColumn("refresh", F.lit("dead"))
    half.write.partitionBy("refresh").parquet(f"{store}/states")
    groups = incremental.refresh_groups(spark, store, listed(spark, [("a", "1")]), lambda _: series)
    full = grouping.group_series(series.drop("directory"))
    assert sorted(map(str, groups.collect())) == sorted(map(str, full.collect()))


def test_order_from_columns_without_row_numbers(spark, tmp_path):
    series = spark.createDataFrame(rows_of("a", range(20)) + rows_of("b", range(9)), COLUMNS).drop("row_ord")
    now = listed(spark, [("a", "1"), ("b", "1")])
    groups = incremental.refresh_groups(spark, str(tmp_path / "s"), now, lambda _: series)
    full = grouping.group_series(series.drop("directory"))
    assert sorted(map(str, groups.collect())) == sorted(map(str, full.collect()))


def test_only_partitions_of_changed_directories_are_scanned(spark, tmp_path):
    series = spark.createDataFrame(rows_of("a", range(500)) + rows_of("b", range(9)), COLUMNS)
    series.write.partitionBy("directory").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    changed = listed(spark, [("b", "1")]).where("fingerprint = '1'").select("directory")
    states = incremental.group_states(table.join(changed, "directory", "left_semi"))
    assert "dynamicpruning" in states._jdf.queryExecution().toString()
    assert {r.directory for r in states.collect()} == {"b"}


def test_unknown_null_keys(spark):
    with pytest.raises(ValueError):
        incremental.group_states(spark.createDataFrame([], COLUMNS), "other")
