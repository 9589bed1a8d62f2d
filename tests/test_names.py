"""Classification, path building, path checks and mapping repair."""

import json

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import keywords, naming
from seriesloom.operators import catalog as cat
from seriesloom.operators import classify, inference


def classified(spark, catalog, *rows):
    columns = (
        "series_description string, protocol_name string, sequence_name string, dim1 string, "
        "dim2 string, dim3 string, dim4 string"
    )
    return classify.classify_series(spark.createDataFrame(list(rows), columns), catalog).collect()


def test_documented_classifications(spark, catalog):
    rows = classified(
        spark,
        catalog,
        ("T1_MPRAGE", "T1w_MPR", "MPRAGE", "256", "256", "176", "1"),
        ("BOLD_rest", "resting_state_fmri", "EPI", "64", "64", "35", "200"),
        ("DTI_30dir", "diffusion_AP", "DWI", "128", "128", "64", "31"),
    )
    assert [(r["modality"], r["suffix"]) for r in rows] == [
        ("anat", "T1w"),
        ("func", "bold"),
        ("dwi", "dwi"),
    ]
    assert rows[0]["confidence"] > 0.8
    assert rows[1]["entities"] == {"task": "rest"}
    assert rows[2]["entities"] == {"direction": "AP"}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("forest walk", ("func", "bold", {"task": "rest"}, 0.9)),
        ("the task faces run", ("func", "bold", {"task": "faces"}, 0.9)),
        ("faces mytask", ("func", "bold", {"task": "unknown"}, 0.9)),
        ("task task", ("func", "bold", {"task": "task"}, 0.9)),
        ("fmri plain", ("func", "bold", {}, 0.9)),
        ("t2 flair", ("anat", "FLAIR", {}, 0.9)),
        ("cube", ("anat", "T2w", {}, 0.9)),
        ("flair only", ("mri", "T1w", {}, 0.0)),
        ("dti pa", ("dwi", "dwi", {"direction": "PA"}, 0.9)),
        ("dti posterior pa", ("dwi", "dwi", {"direction": "AP"}, 0.9)),
        ("field magnitude phase", ("fmap", "magnitude", {}, 0.8)),
        ("shim phase", ("fmap", "phasediff", {}, 0.8)),
        ("b0", ("fmap", "fieldmap", {}, 0.8)),
        ("pasl", ("perf", "asl", {}, 0.9)),
        ("localizer", ("mri", "T1w", {}, 0.0)),
    ],
)
def test_cascade(spark, catalog, text, expected):
    row = classified(spark, catalog, (text, None, "", "64", "64", "1", "1"))[0]
    assert (row["modality"], row["suffix"], row["entities"], row["confidence"]) == expected


def test_dimensions_adjust(spark, catalog):
    several, fine = classified(
        spark,
        catalog,
        ("t1", "", "", "64", "64", "1", "2"),
        ("bold", "", "", "512", "64", "1", "9"),
    )
    assert (several["modality"], several["suffix"], several["confidence"]) == ("func", "bold", 0.9)
    assert (fine["modality"], round(fine["confidence"], 4)) == ("func", 0.7)


def template(spark, entities, include_session=True):
    df = spark.range(1).select(
        naming.path_template(
            F.lit("func"),
            F.lit("bold"),
            F.from_json(F.lit(json.dumps(entities)), "map<string,string>"),
            cat.ENTITY_ORDER,
            include_session,
        )
    )
    return df.first()[0]


def test_path_template(spark):
    assert (
        template(spark, {"run": "7", "task": "rest", "nonsense": "x", "acquisition": "a"})
        == "sub-{subject}/{session}/func/sub-{subject}_{session}_task-rest_acquisition-a"
        "_run-{item:02d}_bold"
    )
    assert template(spark, {}, False) == "sub-{subject}/func/sub-{subject}_bold"


def checks(spark, catalog, *paths, strict=False):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return [r["check"] for r in cat.validate_paths(df, catalog, strict).collect()]


def test_valid_and_invalid_paths(spark, catalog):
    good, bad, short = checks(
        spark,
        catalog,
        "sub-01/ses-baseline/anat/sub-01_ses-baseline_T1w.nii.gz",
        "subject-01/anat/T1w.nii.gz",
        "subject-01/T1w.nii.gz",
    )
    assert good["valid"] and good["errors"] == [] and good["warnings"] == []
    assert good["entities"] == {"sub": "01", "ses": "baseline"}
    assert not bad["valid"] and len(bad["errors"]) == 1
    assert not short["valid"] and short["entities"] == {} and short["warnings"] == []


def test_path_details(spark, catalog):
    folded, repeated, odd, absolute = checks(
        spark,
        catalog,
        "sub-01//./func/sub-01_task-rest_bold.nii/",
        "sub-01/func/sub-01_task-a_task-b-c_bold.nii",
        "sub-01/eeg/sub-01_x_foo-1_eeg.edf",
        "/sub-01/anat/sub-01_T1w.nii",
    )
    assert folded["valid"] and folded["warnings"] == []
    assert repeated["entities"] == {"sub": "01", "task": "b-c"}
    assert len(odd["warnings"]) == 4 and odd["entities"] == {"sub": "01", "foo": "1"}
    assert not absolute["valid"]


def test_strict_check_warns_about_ordinary_paths(spark, catalog):
    (row,) = checks(spark, catalog, "sub-01/anat/sub-01_T1w.nii.gz", strict=True)
    assert row["valid"] and len(row["warnings"]) == 2


def test_built_paths_pass_the_check(spark, catalog):
    built = classified(
        spark,
        catalog,
        ("t1", "", "", "64", "64", "1", "1"),
        ("bold rest", "", "", "64", "64", "1", "1"),
        ("dti ap", "", "", "64", "64", "1", "1"),
        ("b0 phase", "", "", "64", "64", "1", "1"),
    )
    frame = spark.createDataFrame(
        [(r["modality"], r["suffix"], r["entities"]) for r in built],
        "modality string, suffix string, entities map<string,string>",
    )
    paths = classify.with_path_template(frame, catalog).select(
        F.concat(
            F.replace(
                F.replace("path_template", F.lit("{subject}"), F.lit("1")),
                F.lit("{session}"),
                F.lit("ses-1"),
            ),
            F.lit(".nii.gz"),
        ).alias("path")
    )
    assert all(r["check"]["valid"] for r in cat.validate_paths(paths, catalog).collect())


def repaired(spark, catalog, mapping):
    columns = (
        "bids_modality string, bids_suffix string, bids_entities string, "
        "bids_confidence string, bids_path string"
    )
    df = spark.createDataFrame([mapping], columns).withColumn(
        # A Python dict would arrive as an unordered map.
        "bids_entities", F.from_json("bids_entities", "map<string,string>")
    )
    return df.select(
        naming.repair_mapping(F.struct("*"), cat.mri_datatypes(catalog)).alias("m")
    ).first()["m"]


def test_mapping_repair(spark, catalog):
    empty = repaired(spark, catalog, (None, None, None, None, None))
    assert empty.asDict() == {
        "bids_modality": "unknown",
        "bids_suffix": "unknown",
        "bids_entities": {},
        "bids_confidence": 0.25,
        "bids_path": "unmapped",
    }
    kept = repaired(spark, catalog, ("eeg", "eeg", "{}", "0.8", "eeg/x"))
    assert (kept["bids_modality"], kept["bids_suffix"], kept["bids_path"]) == (
        "unknown",
        "eeg",
        "eeg/x",
    )
    assert kept["bids_confidence"] == 0.4
    built = repaired(spark, catalog, ("func", "bold", '{"task": "a", "run": 1}', "2", ""))
    assert built["bids_path"] == "func/sub-{subject}_ses-{session}_task-a_run-1_bold"
    assert built["bids_confidence"] == 2.0


def test_last_resort_rules(spark, catalog):
    rows = [
        ("T1_MPRAGE", "x"),
        ("ax_flair", ""),
        ("rest", "functional"),
        ("x", "y"),
        (None, None),
        ("prot", "1"),
    ]
    df = spark.createDataFrame(rows, "protocol_name string, series_description string")
    mapped = inference.map_by_keywords(df, catalog).collect()
    assert [(r["bids_modality"], r["bids_suffix"], r["bids_confidence"]) for r in mapped] == [
        ("anat", "T1w", 0.6),
        ("anat", "T2w", 0.6),
        ("func", "bold", 0.6),
        ("unknown", "unknown", 0.3),
        ("unknown", "unknown", 0.3),
        # No separator: the words meet as "prot1".
        ("anat", "T1w", 0.6),
    ]
    assert mapped[2]["bids_entities"] == {"task": "unknown"}
    without = df.select(
        keywords.last_resort(F.col("protocol_name"), F.col("series_description"), ["func"]).alias(
            "m"
        )
    ).first()["m"]
    assert (without["bids_modality"], without["bids_path"]) == ("unknown", "unmapped")
