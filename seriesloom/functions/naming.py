"""Building, repairing and checking standard path names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.keywords import UNKNOWN, UNMAPPED

# Extensions a data file may carry.
EXTENSIONS = [".nii.gz", ".nii", ".json", ".tsv", ".bval", ".bvec"]

EMPTY_MAP = "map<string,string>"


def path_template(
    modality: Column,
    suffix: Column,
    entities: Column,
    order: list[str],
    include_session: bool = True,
) -> Column:
    """Path pattern with entities in catalog order; subject and session lead that order.

    The order is known when the plan is built, so this is one flat expression per entity and
    not a lambda, which would leave generated code.
    """

    def part(name: str) -> Column:
        given = F.map_contains_key(entities, name)
        if name == "run":
            return F.when(given, F.lit("run-{item:02d}"))
        return F.when(given, F.concat(F.lit(f"{name}-"), F.try_element_at(entities, F.lit(name))))

    lead = ["sub-{subject}", "{session}"] if include_session else ["sub-{subject}"]
    stem = F.concat_ws("_", *[F.lit(p) for p in lead], *[part(n) for n in order[2:]], suffix)
    return F.concat_ws("/", *[F.lit(p) for p in lead], modality, stem)


_ODD_COMPONENT = r"(^|/)\.?(/|$)"


def clean_path(path: Column) -> Column:
    """Path without '//', '/./' and a trailing '/'. Ordinary paths pass untouched."""
    named = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    root = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(_ODD_COMPONENT), F.concat(root, F.array_join(named, "/"))).otherwise(
        path
    )


# A "key-value" part of a file name that is not its last part (the suffix).
_KEYS = r"(?:^|_)([^_-]*)-[^_]*(?=_)"
_VALUES = r"(?:^|_)[^_-]*-([^_]*)(?=_)"


def last_per_key(keys: Column, values: Column) -> Column:
    """Map of keys to values, a repeated key keeping its last value."""
    distinct = F.array_distinct(keys)
    # Repeats are rare; without them the lists are the map.
    last = F.transform(
        distinct, lambda k: F.get(values, F.size(keys) - F.array_position(F.reverse(keys), k))
    )
    return F.when(F.size(distinct) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(
        F.map_from_arrays(distinct, last)
    )


def with_path_fields(paths: DataFrame) -> DataFrame:
    """Add ``datatype, suffix, entity_keys, entity_values`` of each ``path``, and helpers.

    Helpers stay as columns because each is read several times.
    """
    clean = F.col("clean_path")
    return (
        paths.withColumn("clean_path", clean_path(F.col("path")))
        .withColumns(
            {
                "depth": F.length(clean) - F.length(F.replace(clean, F.lit("/"), F.lit(""))) + 1,
                "file_name": F.substring_index(clean, "/", -1),
            }
        )
        .withColumn("stem", F.substring_index("file_name", ".", 1))
        .withColumns(
            {
                "datatype": F.when(
                    F.col("depth") > 1,
                    F.substring_index(F.substring_index(clean, "/", -2), "/", 1),
                ),
                "suffix": F.substring_index("stem", "_", -1),
                "entity_keys": F.regexp_extract_all("stem", F.lit(_KEYS), 1),
                "entity_values": F.regexp_extract_all("stem", F.lit(_VALUES), 1),
            }
        )
    )


PATH_HELPERS = ["clean_path", "depth", "file_name", "stem"]


def check_path(
    datatypes: list[str], suffixes: dict[str, list[str]], entity_names: list[str]
) -> Column:
    """Struct ``valid, errors, warnings, entities`` from the columns of ``with_path_fields``."""
    none = F.array().cast("array<string>")
    file_name = F.col("file_name")
    datatype, suffix, keys = F.col("datatype"), F.col("suffix"), F.col("entity_keys")
    too_short = F.col("depth") < 3
    listed = "[" + ", ".join(datatypes) + "]"
    suffix_valid = F.lit(False)
    valid_list = F.lit("[]")
    for name, allowed in suffixes.items():
        suffix_valid = suffix_valid | ((datatype == name) & suffix.isin(allowed))
        valid_list = F.when(datatype == name, F.lit("[" + ", ".join(allowed) + "]")).otherwise(
            valid_list
        )
    good_prefix = F.col("clean_path").startswith("sub-")
    errors = (
        F.when(too_short, F.array(F.lit("short: subject, datatype and file name are needed")))
        .when(good_prefix, none)
        .otherwise(F.array(F.lit("subject: no sub- directory at the start")))
    )
    fixed_warnings = F.array(
        F.when(
            ~datatype.isin(datatypes),
            F.concat(F.lit("datatype: "), datatype, F.lit(f" is none of {listed}")),
        ),
        F.when(
            ~_ends_with_any(file_name, EXTENSIONS),
            F.concat(F.lit("extension: none that is known ends "), file_name),
        ),
        F.when(
            ~suffix_valid,
            F.concat(
                F.lit("suffix: "),
                suffix,
                F.lit(" is not used with "),
                datatype,
                F.lit(", which has "),
                valid_list,
            ),
        ),
    )
    names = F.array(*[F.lit(n) for n in entity_names])
    # The lambdas run only where there is something to warn about.
    entity_warnings = F.when(F.size(F.array_except(keys, names)) == 0, none).otherwise(
        F.transform(
            F.filter(keys, lambda k: ~k.isin(entity_names)),
            lambda k: F.concat(F.lit("entity: "), k, F.lit(" is unknown")),
        )
    )
    return F.struct(
        (~too_short & good_prefix).alias("valid"),
        errors.alias("errors"),
        F.when(too_short, none)
        .otherwise(F.concat(F.array_compact(fixed_warnings), entity_warnings))
        .alias("warnings"),
        F.when(too_short, F.create_map().cast(EMPTY_MAP))
        .otherwise(last_per_key(keys, F.col("entity_values")))
        .alias("entities"),
    )


def _ends_with_any(text: Column, endings: list[str]) -> Column:
    result = F.lit(False)
    for ending in endings:
        result = result | text.endswith(ending)
    return result


def repair_mapping(mapping: Column, mri_datatypes: list[str]) -> Column:
    """Defaults, datatype check and path rebuild for one model mapping.

    ``mapping`` is a struct of texts plus an entity map. An unknown datatype halves the
    confidence and keeps suffix and path; an empty path is rebuilt when both parts are known.
    """
    empty = F.create_map().cast(EMPTY_MAP)
    given = mapping["bids_modality"]
    known = F.coalesce(given.isin(mri_datatypes), F.lit(False))
    modality = F.when(known, given).otherwise(F.lit(UNKNOWN))
    suffix = F.coalesce(mapping["bids_suffix"], F.lit(UNKNOWN))
    entities = F.coalesce(mapping["bids_entities"], empty)
    score = F.coalesce(mapping["bids_confidence"].try_cast("double"), F.lit(0.5))
    path = F.coalesce(mapping["bids_path"], F.lit(UNMAPPED))
    rebuilt = F.concat(
        modality,
        F.lit("/"),
        F.concat_ws(
            "_",
            F.lit("sub-{subject}"),
            F.lit("ses-{session}"),
            F.transform(
                F.map_entries(entities),
                lambda e: F.concat(e["key"], F.lit("-"), F.coalesce(e["value"], F.lit("None"))),
            ),
            suffix,
        ),
    )
    final_path = (
        F.when(~path.isin("", UNMAPPED), path)
        .when((modality != UNKNOWN) & (suffix != UNKNOWN), rebuilt)
        .otherwise(F.lit(UNMAPPED))
    )
    return F.struct(
        modality.alias("bids_modality"),
        suffix.alias("bids_suffix"),
        entities.alias("bids_entities"),
        F.when(known, score).otherwise(score * 0.5).alias("bids_confidence"),
        final_path.alias("bids_path"),
    )
