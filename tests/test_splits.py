"""Tables read in byte ranges, against one pass over the whole text."""

import random

import pytest

from seriesloom.sources import splits, tables


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield use
    for name, value in old.items():
        spark.conf.set(name, value)


def plain_records(text):
    """Character by character; a quote that no later one closes is an ordinary character."""
    out, record, at = [], "", 0
    fresh = True
    while at < len(text):
        c = text[at]
        if c == '"' and fresh:
            end = at + 1
            while end < len(text):
                if text[end] == '"':
                    if text[end + 1 : end + 2] == '"':
                        end += 2
                        continue
                    break
                end += 1
            if end < len(text):
                record += text[at : end + 1]
                at, fresh = end + 1, False
                continue
        if c == "\n":
            out.append(record)
            record, fresh = "", True
        else:
            record += c
            fresh = c == "\t"
        at += 1
    out.append(record)
    trimmed = [r[:-1] if r.endswith("\r") else r for r in out]
    return [r for r in trimmed if r]


def read(spark, path):
    lines = splits.text_lines(spark.read, str(path))
    rows = splits.records(splits.scanned(spark.read, str(path))).orderBy("file_path", "pos").collect()
    found = {}
    for r in rows:
        mine = found.setdefault(r["file_path"].rsplit("/", 1)[1], [])
        assert r["pos"] == len(mine)
        mine.append(r["line"])
    return found, lines.rdd.getNumPartitions()


@pytest.mark.parametrize("size", [16, 1 << 22])
def test_records_equal_one_pass(spark, tmp_path, small_blocks, size):
    rnd = random.Random(size)
    parts = ["a", "bc", '"', '""', "\t", "\n", "\r\n", '\t"', '"\t', '\n"', " ", "long words here"]
    texts = {
        f"f{i}": "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for i in range(5)
    }
    texts["never_closed"] = 'h\ti\n1\t"open\n2\tx\n\n3\ty "" z\n' + "4\tlast\n" * 4
    texts["long_cell"] = 'h\ti\n1\t"' + "line of a cell\n" * 8 + '"\n2\tx\n'
    texts["blank"] = "\n\n\r\n\n"
    texts["turns"] = 'a\t"b\n"\t"c\n"\t"d\n"\nx\ty\n'
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    small_blocks(size)
    found, tasks = read(spark, tmp_path)
    for name, text in texts.items():
        assert found.get(name, []) == plain_records(text), (name, text)
    if size < 100:
        assert tasks > len(texts)


def test_one_table_in_many_tasks(spark, tmp_path, small_blocks):
    small_blocks(64)
    rows = "".join(f'{i}\t"note ""{i}""\nsecond line\tof it"\n' for i in range(20))
    (tmp_path / "t.tsv").write_text("series_id\tnote\n" + rows)
    table = tables.read_table(spark, str(tmp_path / "t.tsv"))
    got = {r["series_id"]: r["note"] for r in table.collect()}
    assert got == {str(i): f'note "{i}"\nsecond line\tof it' for i in range(20)}
    assert splits.text_lines(spark.read, str(tmp_path)).rdd.getNumPartitions() > 8


def test_headers_are_bound_per_file(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("series_id\tnote\n1\tx\n")
    (tmp_path / "b.tsv").write_text("note\tseries_id\ny\t2\n")
    got = {(r["series_id"], r["note"]) for r in tables.read_table(spark, str(tmp_path)).collect()}
    assert got == {("1", "x"), ("2", "y")}


def test_header_longer_than_its_block_is_an_error(spark, tmp_path, small_blocks):
    (tmp_path / "t.tsv").write_text('series_id\t"a header\nof ' + "many\n" * 30 + 'lines"\n1\tx\n')
    small_blocks(32)
    found = splits.with_headers(splits.scanned(spark.read, str(tmp_path)))
    with pytest.raises(Exception, match="does not end in the first block"):
        found.collect()


def test_no_lines(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("")
    assert splits.records(splits.scanned(spark.read, str(tmp_path))).count() == 0
    assert splits.with_headers(splits.scanned(spark.read, str(tmp_path))).count() == 0


def test_plan_is_built_in_functions(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    plan = splits.records(splits.scanned(spark.read, str(tmp_path)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
