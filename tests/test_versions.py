import json
import random

import pytest

from seriesloom.operators import catalog as cat
from seriesloom.operators import versions
from seriesloom.operators.containment import contained

ENTITIES = {"subject": {"name": "sub"}, "run": {"name": "run"}, "acquisition": {"name": "acq"}}


def document(version, raw, common=None, modalities=None, entities=ENTITIES):
    files = {"raw": raw} if common is None else {"raw": raw, "common": common}
    tree = {"objects": {"entities": entities}, "rules": {"files": files}}
    if modalities:
        tree["rules"]["modalities"] = modalities
    return tree if version is None else {"schema_version": version, **tree}


def rule(suffixes, *entities):
    return {"suffixes": suffixes, "entities": {e: "optional" for e in entities}}


def written(folder, **documents):
    for name, tree in documents.items():
        text = tree if isinstance(tree, str) else json.dumps(tree, indent=1)
        (folder / f"{name}.json").write_text(text)
    return str(folder)


@pytest.fixture
def loaded(spark, tmp_path):
    small = {"anat": {"a": rule(["T1w"], "subject", "run")}}
    more = {
        "anat": {
            "a": rule(["T2w", "T1w"], "subject", "run"),
            "b": rule({"x": "T1w"}, "subject", "acquisition"),
            "bare": {"suffixes": ["defaced"]},
            "listed": {"suffixes": ["angio"], "entities": ["subject"]},
        },
        "eeg": {"e": rule(["eeg"], "subject")},
    }
    path = written(
        tmp_path,
        one=document("1.9.0", small),
        two=document(
            "1.10.0",
            more,
            common=[{"suffixes": ["scans"], "entities": ["subject"], "datatypes": ["anat"]}],
            modalities={"mri": {"datatypes": ["anat"]}, "eeg": {"datatypes": ["eeg"]}},
        ),
        # One version may come in several documents.
        two_more=document("1.10.0", {"func": {"f": rule(["bold"], "subject", "run")}}),
        three=document("1.10.0-rc1", small),
        master=document(None, {"anat": {"m": rule(["PDw"], "subject")}}),
        broken="[not json",
        empty="{}",
    )
    return versions.load_versions(spark, path)


def test_versions_are_chosen_by_number(spark, loaded):
    names = ["latest", "1.9.0", "1.10.0", "1.10.0-rc1", "2.0.0", "master", "nightly", "", None, "latest"]
    asked = spark.createDataFrame([(n,) for n in names], "asked string")
    rows = versions.choose_versions(asked, loaded).collect()
    assert len(rows) == 9
    assert {r["asked"]: r["version"] for r in rows} == {
        "latest": "1.10.0",
        "1.9.0": "1.9.0",
        "1.10.0": "1.10.0",
        "1.10.0-rc1": "1.10.0-rc1",
        "2.0.0": None,
        "master": "master",
        "nightly": "1.10.0",
        "": "1.10.0",
        None: "1.10.0",
    }


def test_dimensions_of_a_version(loaded):
    def in_order(table, datatype, name):
        rows = table.where(f"version = '1.10.0' AND datatype = '{datatype}'").orderBy("seen")
        return [r[name] for r in rows.collect()]

    suffixes = versions.suffixes(loaded)
    assert in_order(suffixes, "anat", "suffix") == ["T2w", "T1w", "defaced", "angio"]
    # The version says that "mri" has "anat" alone, though another document has a rule of "func".
    assert in_order(suffixes, "mri", "suffix") == ["T2w", "T1w", "defaced", "angio"]
    assert in_order(versions.entities(loaded), "anat", "entity") == ["subject", "run", "acquisition"]
    assert in_order(versions.entities(loaded), "anat", "short_name") == ["sub", "run", "acq"]
    # A version that says nothing has the usual datatypes.
    first = suffixes.where("version = '1.9.0' AND datatype = 'mri'").collect()
    assert [r["suffix"] for r in first] == ["T1w"]
    rules = versions.rules_of(loaded, "anat").where("version = '1.10.0'").collect()
    assert sorted(r["source"] for r in rules) == ["common"] + ["raw"] * 4
    assert versions.rules_of(loaded, "nothing").count() == 0


def parsed(spark, rows):
    return cat.parse_paths(
        spark.createDataFrame(rows, "path_id int, path string, asked string, verdict string")
    )


def test_paths_against_the_version_they_ask_for(spark, loaded):
    rows = [
        ("sub-1/anat/sub-1_run-1_T1w.nii", "1.9.0", True, [], "legal"),
        ("sub-1/anat/sub-1_acq-a_T1w.nii", "1.9.0", True, ["acq"], "illegal"),
        ("sub-1/anat/sub-1_acq-a_T1w.nii", "latest", True, [], "legal"),
        # Both entities are known, but no rule has both.
        ("sub-1/anat/sub-1_acq-a_run-1_T1w.nii", "latest", True, [], "illegal"),
        ("sub-1/anat/sub-1_zzz-1_acq-a_zzz-2_T2w.nii", "latest", True, ["zzz"], "illegal"),
        ("sub-1/anat/defaced.nii", "latest", True, [], "legal"),
        ("sub-1/anat/sub-1_angio.nii", "latest", True, [], "illegal"),
        ("sub-1/func/sub-1_bold.nii", "1.9.0", False, ["sub"], "unknown suffix"),
        ("sub-1/func/sub-1_bold.nii", None, True, [], "legal"),
        ("sub-1/anat/sub-1_PDw.nii", "master", True, [], "legal"),
        ("sub-1/anat/sub-1_T1w.nii", "2.0.0", None, None, None),
        ("sub-1_T1w.nii", "1.9.0", False, ["sub"], "unknown suffix"),
        ("", "1.9.0", False, [], "unknown suffix"),
        (None, "1.9.0", False, None, "unknown suffix"),
    ]
    data = [(i, path, asked, "extra") for i, (path, asked, *_) in enumerate(rows)]
    with pytest.raises(ValueError):
        versions.check_paths(parsed(spark, data), loaded)
    frame = parsed(spark, data + data[:1]).withColumnRenamed("verdict", "held")
    found = versions.check_paths(frame, loaded).collect()
    assert len(found) == len(rows) + 1 and {r["held"] for r in found} == {"extra"}
    for r in found:
        got = (r["suffix_valid"], r["illegal_entities"], r["combination"])
        assert got == rows[r["path_id"]][2:], rows[r["path_id"]]


def test_no_paths_and_no_catalog(spark, loaded, tmp_path):
    nothing = parsed(spark, []).drop("verdict")
    assert versions.check_paths(nothing, loaded).count() == 0
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.json").write_text("{}")
    empty = versions.load_versions(spark, str(tmp_path / "none"))
    one = parsed(spark, [(1, "sub-1/anat/sub-1_T1w.nii", "latest", None)]).drop("verdict")
    row = versions.check_paths(one, empty).first()
    assert (row["version"], row["suffix_valid"], row["combination"]) == (None, None, None)


def test_a_catalog_of_50000_entries(spark, tmp_path):
    """Far more than a plan could hold as literals, in one document and in lines."""
    n = 50_000
    entities = {"subject": {"name": "sub"}, **{f"e{i}": {"name": f"s{i}"} for i in range(n)}}
    raw = {"anat": {f"r{i}": rule([f"S{i}"], "subject", f"e{i}") for i in range(n)}}
    (tmp_path / "whole").mkdir()
    whole = written(tmp_path / "whole", big=document("3.0.0", raw, entities=entities))
    tables = versions.load_versions(spark, whole)
    rows = [(i, f"sub-1/anat/sub-1_s{i}-x_S{i + i % 2}.nii", "latest", None) for i in range(0, n, 997)]
    frame = parsed(spark, rows).drop("verdict")
    checked = versions.check_paths(frame, tables)
    found = {r["path_id"]: r["combination"] for r in checked.collect()}
    assert found == {i: "illegal" if i % 2 else "legal" for i, *_ in rows}
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

    lines = tmp_path / "lines.json"
    texts = [
        json.dumps(document("3.0.0", {"anat": {"r": rule([f"S{i}"], "subject", f"e{i}")}},
                            entities={e: entities[e] for e in ("subject", f"e{i}")}))
        for i in range(n)
    ]
    lines.write_text("\n".join(texts))
    cut = versions.load_versions(spark, str(lines), lines=True)
    again = {r["path_id"]: r["combination"] for r in versions.check_paths(frame, cut).collect()}
    assert again == found


def test_containment_equals_brute_force(spark):
    """5,000 holders under one key, one member in all of them."""
    rng = random.Random(5)
    names = [f"n{i}" for i in range(40)]
    holders = [("k", ["all", *rng.sample(names, 4)]) for _ in range(5_000)]
    holders += [("other", ["n1"]), ("bare", []), ("null", None), (None, ["n1"])]
    sets = [("k", rng.sample([*names, "all", "new"], rng.randrange(0, 5))) for _ in range(1_500)]
    sets += [("k", ["n1", "n1"]), ("k", None), ("k", []), ("other", ["n2"]), ("other", []),
             ("bare", []), ("bare", ["n1"]), ("null", None), ("none", ["n1"]), (None, ["n1"])]
    schema = "key string, members array<string>"
    rows = contained(
        spark.createDataFrame(sets * 2, schema), spark.createDataFrame(holders, schema), ["key"]
    ).collect()
    by_key = {}
    for key, members in holders:
        if key is not None:
            by_key.setdefault(key, []).append(set(members or ()))
    expected = {}
    for key, members in sets:
        wanted = frozenset(members or ())
        held = by_key.get(key)
        expected[key, tuple(sorted(wanted))] = (
            "no holder" if held is None else "held" if any(wanted <= h for h in held) else "not held"
        )
    assert len(rows) == len(expected)
    assert {(r["key"], tuple(r["members"])): r["verdict"] for r in rows} == expected
    assert {"held", "not held", "no holder"} == set(expected.values())
