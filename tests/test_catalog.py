import json

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import catalog as cat


@pytest.fixture
def written(tmp_path):
    tree = {
        "schema_version": "1.9.0",
        "objects": {
            "entities": {
                "subject": {"name": "sub", "format": "label", "description": "who"},
                "session": {"name": "ses"},
                "task": {"name": "task"},
                "run": {"name": "run", "format": "index"},
            },
            "modalities": {"mri": {"display_name": "MRI"}, "eeg": {}},
            "datatypes": {"func": {"display_name": "Function", "description": "runs"}},
        },
        "rules": {
            "entities": ["subject", "session", "task", "run"],
            "modalities": {"mri": {"datatypes": ["anat", "func"]}, "eeg": {"datatypes": ["eeg"]}},
            "files": {
                "raw": {
                    "anat": {
                        "images": {
                            "suffixes": ["T1w", "T2w"],
                            "entities": {"subject": "required", "run": {"level": "optional"}},
                            "extensions": [".nii"],
                        },
                        "more": {"suffixes": ["T2w", "PDw"], "entities": ["task"]},
                    },
                    "func": {
                        "runs": {
                            "suffixes": {"a": "bold", "b": "sbref"},
                            "entities": {"subject": "", "task": "", "run": ""},
                        }
                    },
                    "eeg": {"eeg": {"suffixes": ["eeg"], "entities": {"task": ""}}},
                },
                "common": [
                    {"suffixes": ["scans"], "entities": ["subject"], "datatypes": ["anat", "func"]}
                ],
            },
        },
    }

    def write(change=None):
        if change:
            change(tree)
        path = tmp_path / "catalog.json"
        path.write_text(json.dumps(tree, indent=1))
        return str(path)

    return write


def test_vocabulary_from_a_file(spark, written):
    catalog = cat.load_catalog(spark, written())
    assert catalog.version == "1.9.0"
    assert catalog.modalities == ("mri", "eeg")
    assert cat.mri_datatypes(catalog) == ["anat", "func"]
    assert cat.valid_suffixes(catalog, "anat") == ["T1w", "T2w", "PDw"]
    assert cat.valid_suffixes(catalog, "func") == ["bold", "sbref"]
    assert cat.valid_suffixes(catalog, "mri") == ["T1w", "T2w", "PDw", "bold", "sbref"]
    assert cat.valid_suffixes(catalog, "nothing") == []
    # A list of entities is not a rule's mapping.
    assert cat.valid_entities(catalog, "anat") == ["subject", "run"]
    with pytest.raises(ValueError):
        cat.valid_entities(catalog, "nothing")
    assert (cat.default_modality(catalog), cat.default_suffix(catalog)) == ("mri", "T1w")
    assert cat.datatype_rollup(catalog)["func"] == {
        "name": "Function",
        "description": "runs",
        "suffixes": ["bold", "sbref"],
    }
    assert cat.entity_rollup(catalog)["session"]["format"] == "string"
    common = cat.rules_table(catalog, "func").where("source = 'common'").collect()
    assert [r["suffixes"] for r in common] == [["scans"]]
    assert cat.entity_suffix_combinations(catalog).where("datatype = 'anat'").count() == 5


def test_entity_order_sources(spark, written):
    def drop_list(tree):
        del tree["rules"]["entities"]
        tree["objects"]["entities"]["run"]["order"] = 1
        tree["objects"]["entities"]["task"]["order"] = "2"
        tree["objects"]["entities"]["session"]["order"] = "no number"

    assert cat.load_catalog(spark, written(drop_list)).entity_order == ("run", "task")

    def drop_orders(tree):
        for entity in tree["objects"]["entities"].values():
            entity.pop("order", None)

    assert cat.load_catalog(spark, written(drop_orders)).entity_order == tuple(cat.ENTITY_ORDER)


def test_missing_datatype_list_and_mapped_common_rules(spark, written):
    def change(tree):
        del tree["rules"]["modalities"]["mri"]
        tree["rules"]["files"]["common"] = {
            "scans": {"suffixes": ["scans"], "entities": {"subject": ""}, "datatypes": ["anat"]}
        }

    catalog = cat.load_catalog(spark, written(change))
    assert cat.mri_datatypes(catalog) == cat.MRI_DATATYPES
    assert [r.suffixes for r in catalog.rules if r.source == "common"] == [("scans",)]


def test_size_is_checked(spark, written):
    with pytest.raises(ValueError):
        cat.load_catalog(spark, written(), max_rows=2)


def test_version_strings(spark):
    df = spark.createDataFrame([("1.8.0",), ("1.8",), ("latest",), ("1.8.0-rc1",)], "v string")
    assert [r[0] for r in df.select(cat.is_version(F.col("v"))).collect()] == [
        True,
        False,
        False,
        True,
    ]


def test_patterns(spark, catalog, written):
    single = {r["pattern_key"]: r for r in cat.naming_patterns(catalog).collect()}
    assert single["func_bold"]["pattern"] == (
        "sub-{subject}/{session}/func/sub-{subject}_{session}_bold"
    )
    assert single["func_bold_run"]["pattern"].endswith("_run-{item:02d}_bold")
    assert single["dwi_dwi_direction"]["pattern"].endswith("_direction-{direction}_dwi")
    combined = {r["pattern_key"]: r for r in cat.combined_naming_patterns(catalog).collect()}
    # func: 5 free entities -> 1 + 5 + 10 + 10 sets for one suffix.
    assert sum(r["datatype"] == "func" for r in combined.values()) == 26
    assert combined["full_func_bold_run_task"]["pattern"].endswith(
        "_task-{task}_run-{item:02d}_bold"
    )


def parsed(spark, *paths):
    rows = [(i, p) for i, p in enumerate(paths)]
    return cat.parse_paths(spark.createDataFrame(rows, "path_id int, path string"))


def test_conformance_of_paths(spark, catalog):
    df = parsed(
        spark,
        "sub-1/func/sub-1_task-a_run-1_bold.nii",
        "sub-1/func/sub-1_run-1_task-a_bold.nii",
        "sub-1/anat/sub-1_task-a_T1w.nii",
        "sub-1/anat/sub-1_bold.nii",
    )
    order = {r["path_id"]: r["in_order"] for r in cat.entity_order_breaks(df, catalog).collect()}
    assert order == {0: True, 1: False, 2: True, 3: True}
    illegal = [(r["path_id"], r["short_name"]) for r in cat.illegal_entities(df, catalog).collect()]
    assert illegal == [(2, "task")]
    combos = {r["path_id"]: r["combination"] for r in cat.combination_check(df, catalog).collect()}
    assert combos == {0: "legal", 1: "legal", 2: "illegal", 3: "unknown suffix"}
    valid = {
        r["path_id"]: r["suffix_valid"] for r in cat.with_suffix_validity(df, catalog).collect()
    }
    assert valid == {0: True, 1: True, 2: True, 3: False}
    coverage = cat.pattern_coverage(df, cat.combined_naming_patterns(catalog), catalog)
    seen = {
        (r["datatype"], r["suffix"], r["entity_key"]): (r["n_paths"], r["coverage"])
        for r in coverage.where("coverage <> 'unused'").collect()
    }
    assert seen == {
        ("func", "bold", "run_task"): (2, "covered"),
        ("anat", "T1w", "task"): (1, "uncovered"),
        ("anat", "bold", ""): (1, "uncovered"),
    }


def test_suffix_objects_are_read(spark, tmp_path):
    """Suffixes of the vocabulary, under their value, whether or not a rule uses them."""
    document = {
        "schema_version": "1.0.0",
        "objects": {
            "suffixes": {
                "T1w": {"value": "T1w", "display_name": "T1-weighted"},
                "two_d": {"value": "2d", "description": "flat"},
                "bold": {},
            },
            "modalities": {"mri": {}},
        },
        "rules": {"files": {"raw": {"anat": {"r": {"suffixes": ["T1w"]}}}}},
    }
    path = tmp_path / "schema.json"
    path.write_text(json.dumps(document))
    found = cat.load_catalog(spark, str(path)).suffixes
    assert found == {"T1w": ("T1-weighted", ""), "2d": ("two_d", "flat"), "bold": ("bold", "")}
    assert {"T1w", "bold"} <= set(cat.seed_catalog(spark).suffixes)
