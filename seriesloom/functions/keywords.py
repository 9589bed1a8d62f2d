"""Keyword rules that read a datatype and suffix out of free-text scan names.

Two independent rule sets exist: the catalog-checked cascade (``classify``) and the small
last-resort one (``last_resort``). Their word lists and confidences differ on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cascade order, words, datatype, suffix, confidence. The first row with a word
# in the text wins. "T2" rows split on one more word, fieldmaps on two.
CASCADE_WORDS = {
    "T1": ["t1", "mprage", "anatomy"],
    "T2": ["t2", "space", "cube"],
    "functional": ["bold", "fmri", "func", "rest", "task"],
    "diffusion": ["dwi", "dti", "diffusion", "tensor"],
    "fieldmap": ["fieldmap", "field", "b0", "shim"],
    "perfusion": ["asl", "perfusion", "pcasl", "pasl"],
}
# Words that tell the phase-encoding direction.
AP_WORDS = ["ap", "anterior", "posterior"]
PA_WORDS = ["pa", "posterior", "anterior"]

# Last-resort rules in order (words, datatype, suffix, task, path).
LAST_RESORT = [
    (["t1", "mprage", "anatomical"], "anat", "T1w", None, "anat/sub-{subject}_ses-{session}_T1w"),
    (["t2", "flair"], "anat", "T2w", None, "anat/sub-{subject}_ses-{session}_T2w"),
    (
        ["bold", "fmri", "functional"],
        "func",
        "bold",
        "unknown",
        "func/sub-{subject}_ses-{session}_task-unknown_bold",
    ),
]
UNMAPPED = "unmapped"
UNKNOWN = "unknown"


def mentions(text: Column, words: list[str]) -> Column:
    """Plain substring test: 'forest' mentions 'rest'."""
    return text.rlike("|".join(words))


def search_text(description: Column, protocol: Column, sequence: Column) -> Column:
    blank = F.lit("")
    parts = [F.coalesce(c, blank) for c in (description, protocol, sequence)]
    return F.lower(F.concat_ws(" ", *parts))


def task_label(text: Column) -> Column:
    """'rest', else the word after the first word that contains 'task' and has a successor."""
    words = F.filter(F.split(text, r"\s+"), lambda word: word != "")
    followers = F.filter(
        F.transform(
            words,
            lambda word, i: F.when(word.contains("task"), F.get(words, i + F.lit(1))),
        ),
        lambda word: word.isNotNull(),
    )
    return F.when(text.contains("rest"), F.lit("rest")).when(
        text.contains("task"), F.coalesce(F.get(followers, F.lit(0)), F.lit("unknown"))
    )


def direction_label(text: Column) -> Column:
    """AP is tested first and shares two words with PA."""
    return F.when(mentions(text, AP_WORDS), F.lit("AP")).when(
        mentions(text, PA_WORDS), F.lit("PA")
    )


def branch_of(text: Column) -> Column:
    """Name of the first cascade row with a word in the text; null when none has."""
    branch = None
    for name, words in CASCADE_WORDS.items():
        hit = mentions(text, words)
        branch = F.when(hit, F.lit(name)) if branch is None else branch.when(hit, F.lit(name))
    return branch


def base_class(
    text: Column, branch: Column, valid: dict[str, list[str]], default: tuple[str, str]
) -> dict[str, Column]:
    """Datatype, suffix and confidence of a branch.

    ``valid`` lists the catalog's suffixes per datatype. A branch whose suffix the catalog lacks
    keeps the default, except that a fieldmap always sets datatype and confidence.
    """
    flair = text.contains("flair")
    # (condition, datatype, suffix, confidence) in cascade order.
    outcomes = [
        (branch == "T1", "anat", "T1w", 0.9),
        ((branch == "T2") & flair, "anat", "FLAIR", 0.9),
        ((branch == "T2") & ~flair, "anat", "T2w", 0.9),
        (branch == "functional", "func", "bold", 0.9),
        (branch == "diffusion", "dwi", "dwi", 0.9),
        (branch == "perfusion", "perf", "asl", 0.9),
    ]
    subtype = F.when(text.contains("magnitude"), F.lit("magnitude")).when(
        text.contains("phase"), F.lit("phasediff")
    ).otherwise(F.lit("fieldmap"))
    fieldmap_suffix = F.when(subtype.isin(valid.get("fmap", [])), subtype).otherwise(
        F.lit(default[1])
    )
    is_fieldmap = branch == "fieldmap"
    modality = F.when(is_fieldmap, F.lit("fmap"))
    suffix = F.when(is_fieldmap, fieldmap_suffix)
    confidence = F.when(is_fieldmap, F.lit(0.8))
    for condition, datatype, suffix_name, score in outcomes:
        if suffix_name not in valid.get(datatype, []):
            continue
        modality = modality.when(condition, F.lit(datatype))
        suffix = suffix.when(condition, F.lit(suffix_name))
        confidence = confidence.when(condition, F.lit(score))
    return {
        "modality": modality.otherwise(F.lit(default[0])),
        "suffix": suffix.otherwise(F.lit(default[1])),
        "confidence": confidence.otherwise(F.lit(0.0)),
    }


def as_time_series(
    modality: Column, suffix: Column, confidence: Column, timepoints: Column
) -> dict[str, Column]:
    """Several time points turn an anatomical scan into a functional one."""
    several = (timepoints > 1) & (modality == "anat")
    return {
        "modality": F.when(several, F.lit("func")).otherwise(modality),
        "suffix": F.when(several, F.lit("bold")).otherwise(suffix),
        "confidence": F.when(several, F.greatest(F.lit(0.6), confidence)).otherwise(confidence),
    }


def fine_matrix_penalty(
    modality: Column, confidence: Column, rows: Column, columns: Column
) -> Column:
    """A fine matrix makes "functional" less likely."""
    fine = ((rows >= 512) | (columns >= 512)) & (modality == "func")
    return F.when(fine, F.greatest(F.lit(0.3), confidence - F.lit(0.2))).otherwise(confidence)


def last_resort(protocol: Column, description: Column, mri_datatypes: list[str]) -> Column:
    """Mapping struct from protocol and description joined *without* a separator."""
    blank = F.lit("")
    text = F.lower(F.concat(F.coalesce(protocol, blank), F.coalesce(description, blank)))

    def mapping(modality: Column, suffix: str, task: str | None, score: float, path: Column):
        entities = (
            F.create_map(F.lit("task"), F.lit(task))
            if task
            else F.create_map().cast("map<string,string>")
        )
        return F.struct(
            modality.alias("bids_modality"),
            F.lit(suffix).alias("bids_suffix"),
            entities.alias("bids_entities"),
            F.lit(score).alias("bids_confidence"),
            path.alias("bids_path"),
        )

    result = None
    for words, datatype, suffix, task, path in LAST_RESORT:
        allowed = datatype in mri_datatypes
        outcome = mapping(
            F.lit(datatype if allowed else UNKNOWN),
            suffix,
            task,
            0.6,
            F.lit(path if allowed else UNMAPPED),
        )
        condition = mentions(text, words)
        result = F.when(condition, outcome) if result is None else result.when(condition, outcome)
    return result.otherwise(mapping(F.lit(UNKNOWN), UNKNOWN, None, 0.3, F.lit(UNMAPPED)))
