import ast
import itertools

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import rules, skew
from seriesloom.sources import sinks

MAPPED = (
    "study string, group_no bigint, bids_path string, protocol_name string, "
    "series_description string, sequence_name string, TR double, TE double, is_derived boolean, "
    "is_motion_corrected boolean, image_type string, series_count bigint"
)
SERIES = (
    "study string, series_id string, protocol_name string, series_description string, "
    "sequence_name string, TR double, TE double, is_derived boolean, "
    "is_motion_corrected boolean, image_type string"
)
VARIANTS = "T2w with _rec-norm_ for NORM by image_type"
CONTEXTS = [None, "derived ones apart", "motion", "image_type", VARIANTS]


@pytest.fixture(scope="module")
def mapped(spark):
    texts = ["", "T1", "t1_mprage", "Unknown", "a", "aa", None, "rest's [x]"]
    numbers = [0.0, 500.0, 540.0, 2000.0, 30.0, 34.9, None]
    rows = []
    for i, (p, d) in enumerate(itertools.product(texts, texts)):
        rows.append(
            (
                "one" if i % 3 else "two",
                i + 1,
                [f"anat/sub_{i}_T2w", "unmapped", None, "Unknown", "func/x_bold"][i % 5],
                p,
                d,
                texts[(i * 3) % 8],
                numbers[i % 7],
                numbers[(i * 2) % 7],
                [True, False, None][i % 3],
                i % 2 == 0,
                ["ORIGINAL/NORM", "['DERIVED', 'ND']", None][i % 3],
                i,
            )
        )
    # Nothing to match on.
    rows.append(("one", 99, "anat/y_T1w", None, "", "Unknown", 0.0, 0.0, False, False, None, 1))
    return spark.createDataFrame(rows, MAPPED)


@pytest.fixture(scope="module")
def series(spark):
    texts = ["T1_MPRAGE", "xaay", "a", "", None, "my rest's [x] run"]
    numbers = [500.0, 549.9, 550.0, 450.0, 450.1, 1990.0, 30.0, 35.0, None, float("nan")]
    rows = []
    for i, (p, d, q) in enumerate(itertools.product(texts, texts, texts)):
        rows.append(
            (
                "one" if i % 2 else "two",
                f"s{i}",
                p,
                d,
                q,
                numbers[i % 10],
                numbers[(i * 7) % 10],
                [True, False, None][i % 3],
                [True, False, None][(i // 2) % 3],
                ["ORIGINAL/NORM", "DERIVED, ND", None][i % 3],
            )
        )
    # One attribute tuple with a large share of all rows.
    hot = ("T1_MPRAGE", "a", "a", 500.0, 30.0, True, True, "x/NORM")
    rows += [("one", f"h{i}", *hot) for i in range(90)]
    return spark.createDataFrame(rows, SERIES)


def brute_force(rule_rows, series_rows, context):
    """Direct reading of the rule definition, every rule against every series."""
    mode = rules.context_mode(context)
    found = set()
    for r in rule_rows:
        asked = [
            (r[c].lower(), c)
            for c in ("protocol_name", "series_description", "sequence_name")
            if r[c]
        ]
        if not asked and r["TR"] <= 0 and r["TE"] <= 0:
            continue
        for s in series_rows:
            if s["study"] != r["study"]:
                continue
            if any(text not in (s[c] or "").lower() for text, c in asked):
                continue
            if r["TR"] > 0 and (s["TR"] is None or not abs(s["TR"] - r["TR"]) < 50):
                continue
            if r["TE"] > 0 and (s["TE"] is None or not abs(s["TE"] - r["TE"]) < 5):
                continue
            if mode == "derived" and bool(s["is_derived"]) != r["is_derived"]:
                continue
            if mode == "motion" and bool(s["is_motion_corrected"]) != r["is_motion_corrected"]:
                continue
            if mode == "image_type":
                image = s["image_type"] or ""
                bare = "".join(c for c in r["image_type"] if c not in "'[]")
                if r["variant"] == "norm" and "NORM" not in image:
                    continue
                if r["variant"] == "non_norm" and "NORM" in image:
                    continue
                if r["variant"] == "" and bare not in "".join(c for c in image if c not in "'[]"):
                    continue
            found.add((r["study"], r["key_name"], s["series_id"]))
    return found


@pytest.mark.parametrize("context", CONTEXTS)
def test_matches_equal_brute_force(spark, mapped, series, context):
    built = rules.build_rules(mapped, context).cache()
    tuples = rules.attribute_tuples(series, context).cache()
    expected = brute_force(built.collect(), series.collect(), context)
    assert expected
    # hot_rows=8 sends every tuple with more rows through slices, and keys of the joins through grids.
    for hot_rows in (8, 10**9) if context == VARIANTS else (10**9,):
        found = rules.apply_rules(built, series, tuples, context, hot_rows).collect()
        pairs = [tuple(r) for r in found]
        assert len(pairs) == len(set(pairs)) and set(pairs) == expected
    counts = {
        (r["study"], r["key_name"]): r["n_series"]
        for r in rules.match_counts(built, tuples, context).collect()
    }
    assert len(counts) == built.count()
    for key, n in counts.items():
        assert n == sum(1 for e in expected if e[:2] == key)
    assert 0 in counts.values()


def test_no_plan_compares_all_pairs(spark, mapped, series):
    built, tuples = rules.build_rules(mapped), rules.attribute_tuples(series)
    plan = rules.apply_rules(built, series, tuples)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_names_keep_gaps_and_unmapped_stays(mapped):
    names = {r["key_name"] for r in rules.build_rules(mapped).collect()}
    assert {"key_1", "key_2", "key_5"} <= names and not {"key_3", "key_4"} & names
    assert "key_2" not in {
        r["key_name"] for r in rules.build_rules(mapped, drop_unmapped=True).collect()
    }


def test_variants(mapped):
    rows = {r["key_name"]: r for r in rules.build_rules(mapped, VARIANTS).collect()}
    assert rows["key_1_norm"]["bids_path"] == "anat/sub_0_rec-norm_T2w"
    assert rows["key_1_non_norm"]["bids_path"] == "anat/sub_0_T2w"
    assert "key_1" not in rows and rows["key_2"]["variant"] == ""
    assert rules.context_mode("motion before derived") == "derived"


def test_descriptions(spark):
    rows = [
        ("s", 1, "p", "prot", "desc", "", 2000.0, 30.0, None, None, None, 3),
        ("s", 2, "p", "same", "same", "", 0.0, 0.0, None, None, None, 1),
        ("s", 3, "p", None, "Unknown", "", 0.0, None, None, None, None, 1),
    ]
    built = rules.build_rules(spark.createDataFrame(rows, MAPPED)).orderBy("group_no").collect()
    assert [r["description"] for r in built] == [
        "desc (prot) TR=2000.0ms TE=30.0ms n=3",
        "same",
        "Group key_3",
    ]


@pytest.mark.parametrize("context", CONTEXTS)
def test_program_runs_and_agrees_with_the_join(spark, mapped, series, context, tmp_path):
    built = rules.build_rules(mapped, context).cache()
    summary = rules.study_summary(mapped)
    path = str(tmp_path / "programs")
    sinks.write_programs(rules.program_lines(built, summary, context), path)
    expected = brute_force(built.collect(), series.collect(), context)
    found = set()
    for study in ("one", "two"):
        files = sorted((tmp_path / "programs" / f"study={study}").glob("part-*"))
        source = "".join(f.read_text() for f in files)
        assert ast.parse(source)
        body = source.replace("from heudiconv.utils import SeqInfo", "SeqInfo = object")
        scope = {}
        exec(compile(body, "program", "exec"), scope)  # noqa: S102

        class Row:
            def __init__(self, values):
                self.__dict__.update(values)

        rows = []
        for s in series.where(F.col("study") == study).collect():
            values = s.asDict()
            for c in ("protocol_name", "series_description", "sequence_name", "image_type"):
                values[c] = values[c] or ""
            for c in ("TR", "TE"):
                values[c] = float("nan") if values[c] is None else values[c]
            rows.append(Row(values))
        info = run_with_names(scope, rows, built, study)
        found |= {(study, key, sid) for key, ids in info.items() for sid in ids}
    assert found == expected


def run_with_names(scope, rows, built, study):
    """Key name -> series ids. Keys are told apart by their order of creation."""
    order = [
        r["key_name"]
        for r in built.where(F.col("study") == study).orderBy("group_no", "variant_no").collect()
    ]
    made = []

    def create_key(template):
        made.append((template, len(made)))
        return made[-1]

    scope["create_key"] = create_key
    info = scope["infotodict"](rows)
    assert len(made) == len(order)
    return {order[number]: ids for (_, number), ids in info.items()}


def test_substring_dictionary(spark):
    values = spark.createDataFrame([("abcab",), ("",), ("b",), ("abcab",)], "value string")
    patterns = spark.createDataFrame([("ab",), ("b",), ("",), ("abcabc",), ("c",)], "pattern string")
    pairs = sorted(map(tuple, rules.contained_pairs(values, patterns).collect()))
    assert pairs == [("abcab", "ab"), ("abcab", "b"), ("abcab", "c"), ("b", "b")]


def test_hot_keys_are_bounded(spark):
    counts = spark.range(5000).select(
        F.col("id").alias("k"), F.when(F.col("id") == 7, 3000).otherwise(1).alias("n")
    )
    hot = skew.hot_keys(counts, ["k"], "n", min_rows=1).collect()
    assert [(r["k"], r["slices"]) for r in hot] == [(7, 376)]
    assert skew.hot_keys(counts, ["k"], "n").count() == 0


def test_catch_all(spark, series):
    rows = rules.catch_all(series)
    assert rows.count() == series.count()
    assert {r[0] for r in rows.select("key_name").distinct().collect()} == {"run{item:03d}"}


def test_large_times_are_matched(spark):
    """Values beyond whole-number buckets, and on both sides of the limit."""
    values = [2e15, 1e15 - 10, 1e15 + 10, 5e17, 1e300, 100.0, 130.0]
    columns = "study string, key_name string, protocol_name string, series_description string, "
    columns += "sequence_name string, TR double, TE double, is_derived boolean, "
    columns += "is_motion_corrected boolean, variant string, image_type string, bids_path string"
    made = spark.createDataFrame(
        [("study", f"k{i}", "t1", "", "", v, 0.0, False, False, "", "", "p") for i, v in enumerate(values)],
        columns,
    )
    series = spark.createDataFrame(
        [("study", i, "t1 x", "", "", v, 0.0) for i, v in enumerate(values)],
        "study string, series_id bigint, protocol_name string, series_description string, "
        "sequence_name string, TR double, TE double",
    )
    tuples = rules.attribute_tuples(series)
    found = {(r["key_name"], r["series_id"]) for r in rules.apply_rules(made, series, tuples).collect()}
    want = {
        (f"k{i}", j)
        for i, a in enumerate(values)
        for j, b in enumerate(values)
        if abs(a - b) < rules.TR_TOLERANCE
    }
    assert found == want


def test_grid_cells_are_bounded(spark):
    """One key with half of the rows on both sides, one on the left alone."""
    left = spark.range(4_000).selectExpr("CASE WHEN id < 2000 THEN 'a' WHEN id < 3000 THEN 'b' ELSE CAST(id AS STRING) END AS k", "id")
    right = spark.range(600).selectExpr("CASE WHEN id < 300 THEN 'a' WHEN id = 300 THEN 'b' ELSE CAST(id + 2700 AS STRING) END AS k", "id AS j")
    one, other, cells = skew.grid_sides(left, right, ["k"], 50)
    assert one.groupBy(cells).count().agg(F.max("count")).first()[0] <= 100
    assert other.groupBy(cells).count().agg(F.max("count")).first()[0] <= 100
    pairs = skew.grid_join(left, right, ["k"], 50)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, left.join(right, "k").collect()))


def test_one_protocol_on_half_of_the_tuples(spark):
    """Grids at every join; equal to comparing every rule with every series."""
    words = ["t1", "mprage", "rest", "bold", "x"]
    rows = [
        ("one", f"s{i}", "T1_MPRAGE_long" if i % 2 else f"{words[i % 5]}_{i % 7}", words[i % 3], None,
         float(i % 40), float(i % 9), None, None, None)
        for i in range(240)
    ]
    series = spark.createDataFrame(rows, SERIES)
    given = [
        ("one", i + 1, f"p{i}", ["mprage", "t1", "", "bold_3"][i % 4], ["t1", ""][i % 2], "", [0.0, 20.0][i % 2],
         [0.0, 4.0, 0.0][i % 3], None, None, None, 1)
        for i in range(24)
    ]
    built = rules.build_rules(spark.createDataFrame(given, MAPPED)).cache()
    tuples = rules.attribute_tuples(series).cache()
    found = rules.apply_rules(built, series, tuples, None, 12)
    assert {tuple(r) for r in found.collect()} == brute_force(built.collect(), series.collect(), None)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
