from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import postings, rules
from seriesloom.plans import queries

MATCHES = "study string, key_name string, series_id string, row_ord bigint"


def expected(rows, keys):
    lists = {k: [] for k in keys}
    for study, key, series, order in rows:
        lists.setdefault((study, key), []).append((-1 if order is None else order, series))
    found = set()
    for (study, key), entries in lists.items():
        for i, (_, series) in enumerate(sorted(entries), 1):
            found.add((study, key, i, series))
        if not entries:
            found.add((study, key, None, None))
    return found


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_lists_equal_brute_force(spark, chunk):
    rows = [("a", "hot", f"s{i}", i * 37 % 1009) for i in range(900)]
    rows += [("a", f"k{i % 5}", f"t{i}", i // 3) for i in range(40)]
    rows += [("b", "hot", "u", None), ("b", "hot", "v", 4), ("b", "hot", "v", 4)]
    keys = [("a", "hot"), ("a", "none"), ("a", "none"), ("b", "hot"), ("b", "none"), ("a", "k0")]
    lists = postings.posting_lists(
        spark.createDataFrame(rows, MATCHES).repartition(5),
        spark.createDataFrame(keys, "study string, key_name string"),
        chunk,
    ).cache()
    assert {tuple(r) for r in postings.listed_matches(lists, chunk).collect()} == expected(rows, keys)
    assert max(len(r.ids) for r in lists.collect()) <= chunk
    assert sum(len(r.ids) for r in lists.collect()) == len(rows)
    assert lists.count() == lists.select("study", "key_name", "chunk").distinct().count()


def test_no_matches_and_no_keys(spark):
    none = spark.createDataFrame([], MATCHES)
    keys = spark.createDataFrame([("k",)], "key_name string")
    assert [tuple(r) for r in postings.posting_lists(none, keys).collect()] == [("study", "k", 0, [])]
    assert postings.posting_lists(none, keys.limit(0)).count() == 0


def test_chunk_of_nothing(spark):
    with pytest.raises(ValueError):
        postings.posting_lists(spark.createDataFrame([], MATCHES), spark.createDataFrame([], MATCHES), 0)


def test_runs_go_on_over_batches():
    names = ["study", "key_name", "part", "series_id"]
    rows = [("a", "k", 3, i) for i in range(7)] + [("a", "l", 3, i) for i in range(3)] + [("b", "l", 3, 9)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*part)], names)
        for part in (rows[:2], rows[2:6], rows[6:8], rows[8:])
    ]
    found = [tuple(r.values()) for b in postings._runs(iter(batches), 3) for r in b.to_pylist()]
    assert all(len(ids) <= 3 for *_, ids in found)
    assert [(s, k, start + i, x) for s, k, _, start, ids in found for i, x in enumerate(ids)] == [
        (s, k, x if k == "k" or s == "a" else 0, x) for s, k, _, x in rows
    ]


RULES = "study string, key_name string, protocol_name string, TR double"


def _rules(spark, asked):
    table = spark.createDataFrame(asked, RULES)
    for column in ("series_description", "sequence_name", "image_type", "variant"):
        table = table.withColumn(column, F.lit(""))
    return table.withColumns({"TE": F.lit(0.0), "is_derived": F.lit(False), "is_motion_corrected": F.lit(False)})


def test_keys_that_ask_for_the_same_share_a_list(spark):
    asked = [("a", f"k{i:02}", "BOLD" if i % 2 else "bold", 500.0) for i in range(30)]
    # Another study, other conditions, none, several rules under one key, a text that is missing.
    asked += [("b", "k05", "bold", 500.0), ("a", "m", "bold", 0.0), ("a", "n", "", 0.0), ("a", "o", "", 0.0)]
    asked += [("a", "d", "bold", 500.0), ("a", "d", "t1", 0.0), ("a", "e", "t1", 0.0), ("a", "f", None, 0.0)]
    table = _rules(spark, asked)
    shared = {(r.study, r.key_name): r.shared_key for r in rules.shared_keys(table).collect()}
    assert set(shared) == {(s, k) for s, k, *_ in asked}
    assert {shared["a", f"k{i:02}"] for i in range(30)} == {"k00"}
    assert (shared["b", "k05"], shared["a", "m"], shared["a", "d"], shared["a", "e"]) == ("k05", "m", "d", "e")
    series = [("a", f"s{i}", i, "bold run" if i % 3 else "t1", 500.0 + i % 2) for i in range(60)]
    series += [("b", "s0", 0, "bold", 500.0)]
    given = spark.createDataFrame(series, "study string, series_id string, row_ord bigint, protocol_name string, TR double")
    for column in ("series_description", "sequence_name", "image_type"):
        given = given.withColumn(column, F.lit(""))
    given = given.withColumn("TE", F.lit(0.0))

    def listed(of, chunk=7):
        matches = rules.apply_rules(of, given, rules.attribute_tuples(given))
        return matches.count(), postings.posting_lists(matches, of, chunk)

    everything, lists = listed(table)
    want = sorted(map(tuple, postings.listed_matches(lists, 7).collect()), key=str)
    links = rules.shared_keys(table)
    own = table.join(links.where("key_name = shared_key"), ["study", "key_name"], "left_semi")
    found, lists = listed(own)
    for cell in (1, 1000):
        given_to_all = postings.listed_matches(postings.shared_lists(lists, links, cell), 7)
        assert sorted(map(tuple, given_to_all.collect()), key=str) == want
    assert found < everything / 5


def test_the_query_finds_each_list_once(spark, monkeypatch, tmp_path):
    """120 rules that ask for the same move the matches of one rule."""
    parts = [(i, "Brand#1", "PROMO", 1 + 12 * i) for i in range(4)]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_type string, p_size int").write.parquet(
        f"{tmp_path}/part.parquet"
    )
    events = [(i, datetime(2024, 1, 1), i % 5, "click") for i in range(240)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string").write.parquet(
        f"{tmp_path}/events.parquet"
    )
    moved, lists = [], postings.posting_lists
    monkeypatch.setattr(
        postings, "posting_lists", lambda m, *a, **k: moved.append(m.count()) or lists(m, *a, **k)
    )
    rows = queries.rule_posting_lists(spark, str(tmp_path)).where("position > 0").count()
    assert moved[0] * 5 < rows
