"""Reading rule programs back into rule rows, so that a program can be applied to series.

Nothing is executed. A program is rows of lines; each must be one of the forms that
``rules.program_lines`` writes (conditions in its order), else the whole program goes to quarantine
with a reason. A program may be as long as its study has rules, so lines are never gathered: a test
finds its append by an equi-join on the line after it, and verdicts are aggregates.

Input rows: ``study, block, line_no, line``. A block is a part of a program in which lines follow each other by
``line_no``; a whole text is one block (``text_lines``). A study has one program; a null study is the
default one, a null line is an unknown one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.responses import PROGRAM_MARKS
from seriesloom.operators import rules
from seriesloom.schema import with_study
from seriesloom.staging import stage

# A quoted text with escapes for quote, backslash and line break, as rules are written.
_TEXT = r'"((?:[^"\\\x00]++|\\["\\n])*+)"'
_NUMBER = r"([0-9]+(?:\.[0-9]+)?(?:E-?[0-9]+)?)"
# Conditions in the order in which a test holds them, each at most once.
_CONDITIONS = [
    rf"{_TEXT} in s\.protocol_name\.lower\(\)",
    rf"{_TEXT} in s\.series_description\.lower\(\)",
    rf"{_TEXT} in s\.sequence_name\.lower\(\)",
    rf"abs\(s\.TR - {_NUMBER}\) < {rules.TR_TOLERANCE:.0f}",
    rf"abs\(s\.TE - {_NUMBER}\) < {rules.TE_TOLERANCE:.0f}",
    r"((?:not )?s\.is_derived|(?:not )?s\.is_motion_corrected|"
    r'"NORM" (?:not )?in str\(s\.image_type\))',
    rf"{_TEXT} in image_type",
]
_TEST = r"\A {8}if (?!\z)" + "".join(rf"(?:{c}(?: and (?!\z)|:\z))?" for c in _CONDITIONS) + r"\z"
_DEFINE = rf"(?s)\A {{4}}(\w+) = create_key\({_TEXT}\)(?:  # .*)?\z"
_LISTED = r"\A {8}(\w+): \[\],\z"
_APPEND = r"\A {12}info\[(\w+)\]\.append\(s\.series_id\)\z"
# Why a program goes to quarantine; of several the first is shown.
PROBLEMS = [
    "syntax",
    "part missing",
    "test without append",
    "append without test",
    "key not defined",
    "key defined twice",
    "key tested twice",
]
# What surrounds the rules; comments and blank lines may stand anywhere.
_AROUND = r"(?s)\A\s*\z|\A\s*#.*\z"


def _problem(*cases: tuple[Column, str]) -> Column:
    """Place in ``PROBLEMS`` of the first that holds, null if none does."""
    return F.coalesce(*[F.when(holds, F.lit(PROBLEMS.index(name) + 1)) for holds, name in cases])


def text_lines(programs: DataFrame) -> DataFrame:
    """Lines of ``study, code`` rows."""
    return with_study(programs).select(
        "study",
        F.lit("").alias("block"),
        F.posexplode(F.split(F.coalesce("code", F.lit("")), "\n")).alias("line_no", "line"),
    )


def _plain(quoted: Column) -> Column:
    """A quoted text without its escapes; U+0000 stands for a backslash in between."""
    held = F.replace(quoted, F.lit("\\\\"), F.lit("\x00"))
    held = F.replace(F.replace(held, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(held, F.lit("\x00"), F.lit("\\"))


def _known_lines(lines: DataFrame) -> DataFrame:
    """Each line with its ``kind`` (null: unknown) and the ``key`` it names."""
    line = F.col("line")
    kind = (
        F.when(line.isin(rules.FRAME_LINES) | line.rlike(_AROUND), "around")
        .when(line.rlike(_DEFINE), "define")
        .when(line.rlike(_LISTED), "list")
        .when(line.rlike(_TEST), "test")
        .when(line.rlike(_APPEND), "append")
    )
    key = F.when(F.col("kind") == "define", F.regexp_extract(line, _DEFINE, 1)).when(
        F.col("kind") == "append", F.regexp_extract(line, _APPEND, 1)
    )
    own = with_study(lines).withColumns({"block": F.coalesce("block", F.lit("")), "kind": kind})
    return own.select("study", "block", "line_no", "line", "kind", key.alias("key_name"))


def _asked() -> dict[str, Column]:
    """Rule columns of a test line; without a test a rule asks for nothing."""
    test = F.coalesce("test", F.lit(""))
    part = [F.regexp_extract(test, _TEST, i + 1) for i in range(len(_CONDITIONS))]
    flag = part[5]
    number = {
        name: F.coalesce(F.nullif(text, F.lit("")).try_cast("double"), F.lit(0.0))
        for name, text in (("TR", part[3]), ("TE", part[4]))
    }
    return {
        "protocol_name": _plain(part[0]),
        "series_description": _plain(part[1]),
        "sequence_name": _plain(part[2]),
        **number,
        "is_derived": flag == "s.is_derived",
        "is_motion_corrected": flag == "s.is_motion_corrected",
        "image_type": _plain(part[6]),
        "variant": F.when(flag.contains("not in str"), "non_norm")
        .when(flag.contains("in str"), "norm")
        .otherwise(""),
        "mode": F.when(flag.contains("derived"), "derived")
        .when(flag.contains("motion"), "motion")
        .when(flag.contains("in str") | test.rlike(r" in image_type:\z"), "image_type")
        .otherwise(""),
    }


def read_programs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules of the programs that could be read, and a verdict on every program.

    Rules have the columns that ``rules.apply_rules`` looks at and ``mode``, the filter that a rule's test
    asks for. Verdicts are ``study, accepted, problem, n_rules``.
    """
    known = stage(_known_lines(lines), "program-lines")
    tests = known.where("kind = 'test'").select(
        "study", "block", (F.col("line_no") + 1).alias("line_no"), F.col("line").alias("test")
    )
    appends = known.where("kind = 'append'").select("study", "block", "line_no", "key_name")
    paired = tests.join(appends, ["study", "block", "line_no"], "full")
    tested = paired.where("key_name IS NOT NULL").groupBy("study", "key_name").agg(
        F.count("*").alias("n_tests"), F.max("test").alias("test")
    )
    defined = known.where("kind = 'define'").groupBy("study", "key_name").agg(
        F.count("*").alias("n_defined"), F.max("line").alias("define")
    )
    keyed = stage(defined.join(tested, ["study", "key_name"], "full"), "program-keys")

    of_lines = known.groupBy("study").agg(
        F.min(_problem((F.col("kind").isNull(), "syntax"))).alias("problem"),
        *[F.max(F.contains("line", F.lit(mark))).alias(name) for name, mark in PROGRAM_MARKS.items()],
    )
    complete = reduce(lambda a, b: a & b, [F.coalesce(name, F.lit(False)) for name in PROGRAM_MARKS])
    of_pairs = paired.groupBy("study").agg(
        F.min(
            _problem(
                (F.col("key_name").isNull(), "test without append"),
                (F.col("test").isNull(), "append without test"),
            )
        ).alias("problem")
    )
    of_keys = keyed.groupBy("study").agg(
        F.min(
            _problem(
                (F.col("n_defined").isNull(), "key not defined"),
                (F.col("n_defined") > 1, "key defined twice"),
                (F.col("n_tests") > 1, "key tested twice"),
            )
        ).alias("problem"),
        F.count("n_defined").alias("n_rules"),
    )
    verdicts = stage(
        of_lines.select(
            "study",
            F.coalesce("problem", _problem((~complete, "part missing"))).alias("problem"),
            F.lit(0).cast("bigint").alias("n_rules"),
        )
        .unionByName(of_pairs.withColumn("n_rules", F.lit(0).cast("bigint")))
        .unionByName(of_keys)
        .groupBy("study")
        .agg(F.min("problem").alias("problem"), F.sum("n_rules").alias("n_rules")),
        "program-verdicts",
    ).select(
        "study",
        F.col("problem").isNull().alias("accepted"),
        # ``element_at`` of a literal array does not give null for a null place.
        F.when(F.col("problem").isNotNull(), F.element_at(F.lit(PROBLEMS), F.col("problem"))).alias(
            "problem"
        ),
        "n_rules",
    )
    read = keyed.join(verdicts.where("accepted").select("study"), "study", "left_semi").select(
        "study",
        "key_name",
        _plain(F.regexp_extract("define", _DEFINE, 2)).alias("bids_path"),
        *[c.alias(name) for name, c in _asked().items()],
    )
    return read, verdicts


def apply_programs(read: DataFrame, series: DataFrame) -> DataFrame:
    """``study, key_name, series_id``: what the programs would append, by the matching of rules.

    ``read`` and ``series`` are read several times, so pass staged tables. The modes are four at most.
    """
    modes = sorted(row.mode for row in read.select("mode").distinct().collect())
    found = []
    for mode in modes or [""]:
        tuples = stage(rules.attribute_tuples(series, mode), "tuples")
        found.append(rules.apply_rules(read.where(F.col("mode") == mode), series, tuples, mode))
    return reduce(DataFrame.unionByName, found)


def chosen_matches(
    sources: DataFrame, series: DataFrame, table: DataFrame, read: DataFrame
) -> DataFrame:
    """``study, source, key_name, series_id``: each study's result by its source (``rules.choose_sources``)."""

    def of(source: str, rows: DataFrame) -> DataFrame:
        own = sources.where(F.col("source") == source).select("study")
        return rows.join(own, "study", "left_semi")

    def shown(source: str, matches: DataFrame) -> DataFrame:
        return matches.select("study", F.lit(source).alias("source"), "key_name", "series_id")

    ruled = stage(of("rules", table), "ruled")
    coded = stage(of("model", read), "coded")
    tuples = stage(rules.attribute_tuples(series), "tuples")
    return (
        shown("rules", rules.apply_rules(ruled, series, tuples))
        .unionByName(shown("model", apply_programs(coded, series)))
        .unionByName(shown("catch_all", rules.catch_all(series, sources)))
    )
