import json

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import responses
from seriesloom.operators import grouping, inference
from seriesloom.plans import views
from tests.support import keyword_model

SF_DIR = "/root/testdata/sf0.001"
ONE = '{"bids_modality": "anat", "bids_suffix": "T1w"}'


@pytest.fixture(scope="module")
def numbered(spark):
    groups = grouping.group_series(views.series(spark, SF_DIR))
    return grouping.number_groups(groups).cache()


def elements(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    return [r["elements"] for r in responses.with_elements(df).orderBy("i").collect()]


def test_array_recovery(spark):
    found = elements(
        spark,
        f"[{ONE}]",
        f"  \n[{ONE}, {ONE}]\n",
        f"```json\n[{ONE}]\n```",
        f"```\n[{ONE},\n]\n```\ntrailing words",
        f"Here it is: [{ONE}] and [2] more",
        '[{"a": [1, 2], "b": 3,},]',
        f"[{ONE}",
        "no array",
        "",
        '{"bids_modality": "anat"}',
        "]] [1]",
        "```json [1]```",
    )
    sizes = [None if f is None else len(f) for f in found]
    assert sizes == [1, 2, 1, 1, 1, 1, None, None, None, None, 1, 1]
    assert json.loads(found[5][0]) == {"a": [1, 2], "b": 3}


def expected_array(text):
    """Independent reading of the first balanced array, one character at a time."""
    start = text.find("[")
    depth = 0
    for i in range(max(start, 0), len(text)):
        depth += (text[i] == "[") - (text[i] == "]")
        if start >= 0 and depth == 0:
            return text[start : i + 1]
    return None


def test_bracket_fold_equals_character_count(spark):
    texts = [
        "[[1],[2]] [3]",
        "a]b[c]",
        "[[[",
        "[1]]]",
        "x [ [ ] y [ ] ] z ]",
        "[]",
        "]",
        "",
        "[" * 50 + "]" * 50 + "]",
    ]
    for text, found in zip(texts, elements(spark, *["! " + t for t in texts]), strict=True):
        expected = expected_array(text)
        try:
            size = None if expected is None else len(json.loads(expected))
        except json.JSONDecodeError:
            size = None
        assert (None if found is None else len(found)) == size, text


def answers(spark, *items):
    df = spark.createDataFrame([(i, e) for i, e in enumerate(items)], "i int, element string")
    return [r["answer"] for r in responses.with_answers(df).orderBy("i").collect()]


def test_single_answers(spark):
    full, word, number, no_map, nulls = answers(
        spark,
        '{"bids_modality": "anat", "bids_entities": {"run": 1}, "bids_confidence": "0.5", "x": 1}',
        '{"bids_modality": "anat", "bids_confidence": "high"}',
        "3",
        '{"bids_modality": "anat", "bids_entities": ["a"], "bids_suffix": 7}',
        '{"bids_modality": null}',
    )
    assert full["bids_entities"] == {"run": "1"} and full["bids_confidence"] == "0.5"
    assert word is None and number is None
    assert no_map["bids_entities"] is None and no_map["bids_suffix"] == "7"
    assert nulls["bids_modality"] is None


def test_batches_are_consecutive_tens(spark, numbered):
    batched = inference.assign_batches(numbered)
    sizes = batched.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("group_no").alias("m"))
    rows = sizes.orderBy("batch_id").collect()
    assert [r["n"] for r in rows] == [10] * 86 + [2]
    assert [r["m"] for r in rows] == [1 + 10 * i for i in range(87)]


def test_prompts_split_instead_of_being_cut(spark, catalog, numbered):
    batched = inference.assign_batches(numbered)
    whole = inference.build_prompts(batched, catalog, "note").collect()
    assert len(whole) == 87 and all("NOTES\nnote" in r["prompt"] for r in whole)
    limit = len(whole[0]["prompt"]) - 1000
    split = inference.build_prompts(batched, catalog, "note", max_chars=limit).collect()
    assert len(split) > 87 and max(len(r["prompt"]) for r in split) <= limit

    def records(rows):
        found = {}
        for r in rows:
            body = r["prompt"].split(inference.RECORDS_MARK, 1)[1].split(inference.CONTRACT)[0]
            for i, record in enumerate(json.loads(body)):
                found[(r["batch_id"], r["first_pos"] + i)] = record
        return found

    assert records(whole) == records(split) and len(records(whole)) == 862
    # A record that is too long by itself still gets a prompt.
    tiny = inference.build_prompts(batched, catalog, max_chars=1).collect()
    assert len(tiny) == 862


def test_record_defaults(spark):
    df = spark.createDataFrame([(None, 1.0)], "protocol_name string, TR double")
    record = json.loads(df.select(inference.group_record(df)).first()[0])
    assert record["protocol_name"] == record["image_type"] == "Unknown"
    assert (record["dim1"], record["dim4"], record["series_count"], record["TR"]) == (0, 1, 1, 1)
    assert record["is_derived"] is False and len(record) == 13


def test_split_prompts_map_to_the_right_groups(spark, catalog, numbered):
    plain = inference.map_by_keywords(numbered, catalog)
    mapped = inference.map_groups(
        numbered, catalog, keyword_model(), max_chars=2500, batch_size=7
    )
    assert {r[0] for r in mapped.select("mapping_source").distinct().collect()} == {"model"}
    columns = ["group_id", "bids_modality", "bids_suffix", "bids_path", "suffix_valid"]
    assert sorted(mapped.select(columns).collect()) == sorted(plain.select(columns).collect())


def test_model_failures_fall_back(spark, catalog, numbered):
    def load():
        return lambda prompts: [None if i % 2 else "no json" for i, _ in enumerate(prompts)]

    def short():
        return lambda prompts: ["[]"][: len(prompts) - 1]

    def broken():
        def fail(prompts):
            raise RuntimeError("out of memory")

        return fail

    for loader in (load, short, broken):
        mapped = inference.map_groups(numbered, catalog, loader)
        counts = mapped.groupBy("mapping_source").count().collect()
        assert [tuple(r) for r in counts] == [("fallback", 862)]
    prompts = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    errors = inference.complete(prompts, broken).collect()
    assert {r["model_error"] for r in errors} == {"RuntimeError: out of memory"}
    extra = inference.complete(prompts, lambda: lambda p: ["x"] * 9).collect()
    assert [(r["response"], r["model_error"]) for r in extra] == [("x", None)] * 2


def test_repeated_entities_give_one_path_part(spark, catalog):
    answer = '[{"bids_modality": "func", "bids_suffix": "bold", "bids_entities": {"task":"a","run":"1","task":"b"}}]'
    groups = spark.createDataFrame(
        [("s", 0, 0, "g", "p", "d")],
        "study string, batch_id bigint, pos int, group_id string, protocol_name string, "
        "series_description string",
    )
    answered = groups.selectExpr("study", "batch_id", "0 AS first_pos", "1 AS n_groups").withColumn(
        "response", F.lit(answer)
    )
    row = inference.attach_mappings(groups, inference.recover_mappings(answered), catalog).first()
    assert row["bids_entities"] == {"task": "b", "run": "1"}
    assert row["bids_path"] == "func/sub-{subject}_ses-{session}_task-b_run-1_bold"


def test_surplus_and_missing_mappings(spark, catalog):
    groups = spark.createDataFrame(
        [("s", "g1", 1, "bold", ""), ("s", "g2", 2, "t1", "")],
        "study string, group_id string, group_no bigint, protocol_name string, "
        "series_description string",
    )
    batched = inference.assign_batches(groups)

    def attach(response):
        answered = spark.createDataFrame(
            [("s", 0, 0, 2, response)],
            "study string, batch_id bigint, first_pos int, n_groups int, response string",
        )
        recovered = inference.recover_mappings(answered)
        rows = inference.attach_mappings(batched, recovered, catalog).orderBy("group_id").collect()
        return [(r["bids_suffix"], r["mapping_source"]) for r in rows]

    assert attach(f"[{ONE}, {ONE}, {ONE}]") == [("T1w", "model"), ("T1w", "model")]
    assert attach(f"[{ONE}]") == [("T1w", "model"), ("T1w", "fallback")]
    assert attach(f"[3, {ONE}]") == [("bold", "fallback"), ("T1w", "model")]
    assert attach(ONE) == [("bold", "fallback"), ("T1w", "fallback")]


def test_numbered_lines(spark):
    text = (
        "Intro\n1. anat/sub-x_T1w - why - more\n 2. plain. name\n3 no dot\n- 4. skipped\n"
        "10. a/b/c\n1. func/last"
    )
    df = spark.createDataFrame([("s", 0, text)], "study string, batch_id bigint, response string")
    found = {r["key"]: r["pattern"] for r in inference.parse_numbered(df).collect()}
    assert found == {"sequence_1": "last", "sequence_2": "plain. name", "sequence_10": "b"}


def test_sequence_list_keeps_the_longer_list(spark):
    df = spark.createDataFrame([(["a", "b"], ["p"])], "d array<string>, p array<string>")
    text = df.select(inference.sequence_list_prompt(F.col("d"), F.col("p"))).first()[0]
    assert "#1 protocol=p | description=a\n#2 protocol=Unknown | description=b\n" in text


def test_program_check(spark):
    good = "from heudiconv.utils import SeqInfo\ndef create_key(\ndef infotodict(\n"
    texts = [
        f"x\n```python\n{good}```\ny\n```python\nother```",
        f"```\n{good}```",
        good,
        f"```python\n{good}",
        "```python\npass\n```",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    rows = inference.check_programs(df).orderBy("i").collect()
    assert [r["accepted"] for r in rows] == [True, True, True, True, False]
    assert rows[0]["code"] == rows[1]["code"] == good.strip()
    assert rows[3]["code"] == texts[3]
    kept, rejected = inference.split_programs(df)
    assert (kept.count(), rejected.count()) == (4, 1)


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "bids_path string")
    assert inference.mapping_metrics(empty).first()["mapped_percent"] == 0.0
