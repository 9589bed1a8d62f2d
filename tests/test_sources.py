import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from seriesloom import staging
from seriesloom.operators import grouping
from seriesloom.schema import EMPTY_COLUMNS
from seriesloom.sources import listing, sinks, tables

HEADER = (
    "total_files_till_now\texample_dcm_file\tseries_id\tdcm_dir_name\tunspecified2\tdim1\tdim4\t"
    "TR\tTE\tprotocol_name\tis_motion_corrected\tseries_description"
)
LINE = "1\t/path/to/file.dcm\t001\tseries1\t\t256\t1\t2000\t30\tT1w_MPR\tFalse\tT1 MPRAGE"


def write(root, name, *lines):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f"{line}\n" for line in lines))


def test_one_table(spark, tmp_path):
    write(tmp_path, "aggregated_dicominfo.tsv", HEADER, LINE, LINE.replace("256", "NA"))
    df = tables.load_series(spark, str(tmp_path))
    first, second = df.collect()
    assert first["series_id"] == "001" and first["TR"] == 2000.0
    assert first["is_motion_corrected"] is False and first["unspecified2"] is None
    assert (first["dim1"], second["dim1"]) == ("256", None)


def test_headers_may_differ_between_files(spark, tmp_path):
    root = tmp_path / ".heudiconv"
    write(root, "001/info/dicominfo.tsv", HEADER, LINE, LINE, "")
    write(
        root,
        "002/ses-b/info/dicominfo_ses-b.tsv",
        "protocol_name\tseries_id\textra_column\tseries_description",
        'BOLD\t7\tnote\t"quoted ""text"" with\ttab"',
        "BOLD\t8\t\tshort\tsurplus",
        "BOLD\t9",
    )
    write(root, "003/info/dicominfo.tsv")
    write(root, "004/info/dicominfo.tsv", HEADER)
    write(root, "005/info/other.tsv", HEADER, LINE)
    raw = tables.read_session_tables(spark, str(root))
    rows = {r["series_id"]: r for r in raw.collect()}
    assert raw.count() == 5 and set(rows) == {"001", "7", "8", "9"}
    assert (rows["001"]["subject"], rows["001"]["session"]) == ("001", None)
    assert (rows["7"]["subject"], rows["7"]["session"]) == ("002", "b")
    assert rows["7"]["series_description"] == 'quoted "text" with\ttab'
    assert rows["7"]["extra"] == '[{"name":"extra_column","value":"note"}]'
    assert rows["8"]["extra"] is None and rows["9"]["series_description"] is None
    rebuilt = tables.load_series(spark, str(tmp_path))
    assert rebuilt.count() == 4


def test_records_end_at_line_breaks_outside_quotes(spark, tmp_path):
    """Repeated headers, CRLF, a lone CR and quoted line breaks; a data line equal to the header is
    data."""
    root = tmp_path / "t"
    root.mkdir()
    text = 'series_id\tnote\r\n1\t"two\nlines ""x"""\r\nseries_id\tnote\r\n\n2\ta\rb\n3\t5" tall'
    (root / "dicominfo.tsv").write_bytes(text.encode())
    rows = tables.read_session_tables(spark, str(root)).orderBy("row_ord").collect()
    assert [r["series_id"] for r in rows] == ["1", "series_id", "2", "3"]
    notes = [json.loads(r["extra"])[0]["value"] for r in rows]
    assert notes == ['two\nlines "x"', "note", "a\rb", '5" tall']


def test_first_values_do_not_depend_on_partitions(spark):
    """Without a row id: ids repeat over subjects, and "10" comes after "2"."""
    rows = [("10", "a", "T1", "f1"), ("2", "c", "T1", "f2"), ("2", "b", "T1", "f3"), ("x", "d", "T2", "f4")]
    table = spark.createDataFrame(
        rows, "series_id string, subject string, protocol_name string, example_dcm_file string"
    )
    for n in (1, 4, 200):
        found = grouping.group_series(table.repartition(n)).orderBy("protocol_name").collect()
        assert [(r["representative_series_id"], r["subject"]) for r in found] == [("2", "b"), ("x", "d")]


def test_a_written_table_reads_back(spark, tmp_path):
    values = ['say "hi"\tx', "two\nlines", "back\\slash", "plain", '"']
    table = spark.createDataFrame(list(enumerate(values)), "series_id string, note string")
    sinks.write_table(table, f"{tmp_path}/out")
    back = tables.read_table(spark, f"{tmp_path}/out")
    assert {r["series_id"]: r["note"] for r in back.collect()} == dict(zip("01234", values))
    united = tables.read_session_tables(spark, f"{tmp_path}/out", pattern="*.csv")
    assert {json.loads(r["extra"])[0]["value"] for r in united.collect()} == set(values)


def test_nothing_to_read(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_series(spark, str(tmp_path))
    write(tmp_path, "aggregated_dicominfo.tsv", HEADER)
    with pytest.raises(ValueError):
        tables.load_series(spark, str(tmp_path))
    empty = tables.empty_series(spark)
    assert empty.columns == EMPTY_COLUMNS and empty.count() == 0


def test_union_by_name_dedupe_and_provenance(spark):
    a = spark.createDataFrame([("1", "x"), ("1", "x")], "series_id string, session string")
    b = spark.createDataFrame([("1", "s")], "series_id string, subject string")
    united = tables.drop_repeats(tables.consolidate([a, b]))
    rows = sorted(map(tuple, tables.with_provenance(united).collect()), key=str)
    assert rows == [("1", "x", None, None, "x"), ("1", None, "s", "s", "single_session")]


def test_aliases(spark):
    raw = spark.createDataFrame([("1", "01", None)], "series_id string, subject_id string, x string")
    row = tables.to_series(raw).first()
    assert row["subject"] == "01" and "subject_id" not in row.asDict()


def pairs(spark, *paths, **caps):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = listing.discover_sessions(df, **caps).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_layouts(spark):
    assert pairs(spark, "sub-001/ses-001/a", "sub-001/ses-002/a", "sub-002/ses-001/a", "9/1/a") == [
        ("001", "001"),
        ("001", "002"),
        ("002", "001"),
    ]
    assert pairs(spark, "sub-1/anat/a", "sub-2/ses-x/a", "sub-2/anat/b") == [("1", None), ("2", "x")]
    numbered = ["001/001/a", "001/ses2/a", "001/other/a", "002/x", "3.txt", "x/1/a", "004/5"]
    assert pairs(spark, *numbered) == [
        ("001", "001"),
        ("001", "ses2"),
        ("002", None),
        ("004", None),
    ]
    assert pairs(spark, "file.dcm", "dir/x") == [("01", None)]


def test_listing_of_files(spark, tmp_path):
    write(tmp_path, "sub-1/ses-2/a.dcm", "x")
    write(tmp_path, "sub-1/b.txt", "x")
    files = listing.relative_paths(listing.list_files(spark, str(tmp_path), "*.dcm"), str(tmp_path))
    assert [r["path"] for r in files.collect()] == ["sub-1/ses-2/a.dcm"]
    assert [tuple(r) for r in listing.discover_sessions(files).collect()] == [("1", "2")]


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, length bigint, modificationTime timestamp")


def test_fingerprints(spark):
    day = dt.datetime(2024, 1, 1)
    a, b = ("d/a.dcm", 1, day), ("d/b.dcm", 2, day)
    make = listing.fingerprints
    key = make(files(spark, a, b)).first()["fingerprint"]
    assert len(key) == 32
    assert key == make(files(spark, b, a).repartition(2)).first()["fingerprint"]
    later = ("d/b.dcm", 2, day + dt.timedelta(seconds=1))
    assert key != make(files(spark, a, later)).first()["fingerprint"]
    assert key != make(files(spark, a, b, b)).first()["fingerprint"]
    # A change to any file counts.
    many = [(f"d/{i:03d}.dcm", i, day) for i in range(30)]
    grown = many[:-1] + [("d/029.dcm", 999, day)]
    assert (
        listing.fingerprints(files(spark, *many)).first()
        != listing.fingerprints(files(spark, *grown)).first()
    )


def test_reuse_by_fingerprint(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    old = listing.fingerprints(files(spark, ("x/a", 1, day), ("y/a", 1, day)))
    path = str(tmp_path / "store")
    sinks.store_results(old, path, "/data")
    stored = spark.read.parquet(path)
    assert {"extraction_time", "source_directory"} <= set(stored.columns)
    current = listing.fingerprints(files(spark, ("x/a", 1, day), ("y/a", 2, day), ("z/a", 1, day)))
    reuse, again = listing.split_by_change(current, stored)
    assert [r["directory"] for r in reuse.collect()] == ["x"]
    assert sorted(r["directory"] for r in again.collect()) == ["y", "z"]
    report = {r["directory"]: r["status"] for r in listing.change_report(current, stored).collect()}
    assert report == {"x": "reuse", "y": "recompute", "z": "recompute"}


def test_text_sink_round_trip(spark, tmp_path):
    df = spark.range(1).select(
        F.lit('a "b"').alias("protocol_name"),
        F.lit("7").alias("series_id"),
        F.create_map(F.lit("task"), F.lit("x")).alias("bids_entities"),
    )
    path = str(tmp_path / "out")
    sinks.write_table(df, path)
    back = tables.read_session_tables(spark, path, pattern="*.csv").first()
    assert back["protocol_name"] == 'a "b"' and back["series_id"] == "7"
    assert "task" in back["extra"]
    groups = spark.createDataFrame([("1", "2")], "subject string, session string")
    assert "subject_first" in sinks.with_first_names(groups).columns


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    assert staging.shared_folder(spark)
    staged = staging.stage(spark.range(3), "numbers")
    assert staged.count() == 3

    class Conf:
        def get(self, name, default=None):
            return "s3a://shared/checkpoints/" if name == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert staging.new_path(Session(), "x").startswith("s3a://shared/checkpoints/x-")
