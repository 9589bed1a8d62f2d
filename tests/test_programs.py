"""Programs read back: equal to the rules they were written from, damaged ones set aside."""

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import programs, rules
from tests.test_rules import CONTEXTS, mapped, series  # noqa: F401


def as_rows(lines):
    return lines.withColumn("block", F.concat_ws("/", "section", "group_no", "variant_no"))


def text_of(lines):
    rows = sorted(lines.collect(), key=lambda r: (r.section, r.group_no, r.variant_no, r.line_no))
    return "\n".join(r.line for r in rows)


@pytest.mark.parametrize("form, context", [*(("rows", c) for c in CONTEXTS), ("text", CONTEXTS[-1])])
def test_read_program_matches_like_its_rules(spark, mapped, series, form, context):  # noqa: F811
    built = rules.build_rules(mapped, context).cache()
    lines = rules.program_lines(built, rules.study_summary(mapped), context)
    if form == "rows":
        given = as_rows(lines)
    else:
        texts = [(s, text_of(lines.where(F.col("study") == s))) for s in ("one", "two")]
        given = programs.text_lines(spark.createDataFrame(texts, "study string, code string"))
    read, verdicts = programs.read_programs(given)
    assert {(v.study, v.accepted, v.problem) for v in verdicts.collect()} == {
        ("one", True, None),
        ("two", True, None),
    }
    assert sum(v.n_rules for v in verdicts.collect()) == built.count()
    paths = {(r.study, r.key_name, r.bids_path) for r in built.collect()}
    assert {(r.study, r.key_name, r.bids_path) for r in read.collect()} == paths
    tuples = rules.attribute_tuples(series, context).cache()
    expected = sorted(map(tuple, rules.apply_rules(built, series, tuples, context).collect()))
    assert sorted(map(tuple, programs.apply_programs(read.cache(), series).collect())) == expected
    assert expected


HEAD = "\n".join(rules.FRAME_LINES[:10])
GOOD = (
    HEAD
    + """
    # a note
    key_1 = create_key("anat/x \\\\ \\"y\\"")  # shown
    info = {
        key_1: [],
    }
    for s in seqinfo:
        pass
        if "t1 and \\"a\\" in s.tr" in s.protocol_name.lower() and abs(s.TR - 1.0E10) < 50:
            info[key_1].append(s.series_id)
    return info"""
)
DAMAGED = {
    "good": (GOOD, None),
    "blank": ("", "part missing"),
    "header": (GOOD.replace("from heudiconv.utils import SeqInfo", ""), "part missing"),
    "call": (GOOD.replace("        pass", "        import os"), "syntax"),
    "or": (GOOD.replace('.lower() and', ".lower() or"), "syntax"),
    "open end": (GOOD.replace(" and abs(s.TR - 1.0E10) < 50:", " and :"), "syntax"),
    "no colon": (GOOD.replace("< 50:", "< 50"), "syntax"),
    "tolerance": (GOOD.replace("< 50:", "< 51:"), "syntax"),
    "twice": (GOOD.replace("lower() and", 'lower() and "b" in s.protocol_name.lower() and'), "syntax"),
    "no append": (GOOD.replace("            info[", "            # info["), "test without append"),
    "no test": (GOOD.replace("        if ", "        # if "), "append without test"),
    "key": (GOOD.replace("info[key_1]", "info[key_2]"), "key not defined"),
    "defined": (GOOD.replace("    info = {", '    key_1 = create_key("b")\n    info = {'), "key defined twice"),
    "tested": (
        GOOD.replace(
            "        pass",
            '        if s.is_derived:\n            info[key_1].append(s.series_id)',
        ),
        "key tested twice",
    ),
    "far": (GOOD.replace("            info[", "\n            info["), "test without append"),
}


def test_damaged_programs_are_set_aside(spark):
    texts = spark.createDataFrame([(n, t) for n, (t, _) in DAMAGED.items()], "study string, code string")
    read, verdicts = programs.read_programs(programs.text_lines(texts))
    assert {v.study: v.problem for v in verdicts.collect()} == {n: p for n, (_, p) in DAMAGED.items()}
    assert all(v.accepted == (v.problem is None) for v in verdicts.collect())
    (row,) = read.collect()
    assert (row.study, row.key_name, row.bids_path) == ("good", "key_1", 'anat/x \\ "y"')
    assert (row.protocol_name, row.TR, row.mode) == ('t1 and "a" in s.tr', 1e10, "")


def test_null_and_no_programs(spark):
    texts = spark.createDataFrame([(None, None)], "study string, code string")
    read, verdicts = programs.read_programs(programs.text_lines(texts))
    assert read.count() == 0
    assert [(v.study, v.accepted, v.problem) for v in verdicts.collect()] == [
        ("study", False, "part missing")
    ]
    read, verdicts = programs.read_programs(programs.text_lines(texts.limit(0)))
    assert (read.count(), verdicts.count()) == (0, 0)


def test_each_study_gets_the_result_of_its_source(spark, mapped, series):  # noqa: F811
    built = rules.build_rules(mapped).cache()
    lines = rules.program_lines(built, rules.study_summary(mapped))
    read, _ = programs.read_programs(as_rows(lines))
    tuples = rules.attribute_tuples(series).cache()
    by_rules = rules.apply_rules(built, series, tuples).cache()
    expected = {
        source: {tuple(r) for r in by_rules.where(F.col("study") == study).collect()}
        for source, study in (("rules", "one"), ("model", "two"))
    }
    more = series.withColumn("study", F.lit("three")).unionByName(series)
    sources = spark.createDataFrame(
        [("one", "rules"), ("two", "model"), ("three", "catch_all")], "study string, source string"
    )
    found = programs.chosen_matches(sources, more, built, read.cache()).collect()
    for source, rows in expected.items():
        assert rows == {(r.study, r.key_name, r.series_id) for r in found if r.source == source}
    assert sum(r.source == "catch_all" for r in found) == series.count()
