"""A standard's vocabulary, and the joins that hold tables of names against it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions import naming
from seriesloom.operators.containment import contained

# Datatypes of magnetic resonance imaging, in fallback order.
MRI_DATATYPES = ["anat", "func", "fmap", "dwi", "perf"]
# Suffixes per datatype.
DATATYPE_SUFFIXES = {
    "anat": ["T1w", "T2w", "FLAIR"],
    "func": ["bold"],
    "fmap": ["magnitude", "phasediff", "fieldmap"],
    "dwi": ["dwi"],
    "perf": ["asl"],
}
# Default entity order.
ENTITY_ORDER = [
    "subject",
    "session",
    "task",
    "acquisition",
    "run",
    "echo",
    "direction",
    "reconstruction",
    "space",
    "description",
]
# Short names used in file names.
ENTITY_SHORT = {
    "subject": "sub",
    "session": "ses",
    "task": "task",
    "acquisition": "acq",
    "run": "run",
    "echo": "echo",
    "direction": "dir",
    "reconstruction": "rec",
    "space": "space",
    "description": "desc",
}
_COMMON_ENTITIES = ["subject", "session", "acquisition", "run", "reconstruction"]
DATATYPE_ENTITIES = {
    "anat": _COMMON_ENTITIES,
    "func": _COMMON_ENTITIES + ["task", "echo"],
    "fmap": _COMMON_ENTITIES + ["direction"],
    "dwi": _COMMON_ENTITIES + ["direction"],
    "perf": _COMMON_ENTITIES,
}

VERSION_PATTERN = r"^\d+\.\d+\.\d+"
MAX_CATALOG_ROWS = 20_000


@dataclass(frozen=True)
class Rule:
    """One naming rule of one datatype. ``source`` is ``raw`` or ``common``."""

    source: str
    rule_name: str
    datatype: str
    suffixes: tuple[str, ...]
    entities: tuple[str, ...]
    extensions: tuple[str, ...]


@dataclass(frozen=True)
class Catalog:
    """A standard's vocabulary: configuration of a job, a few hundred entries.

    Its size is checked when it is read (``load_catalog``), so expressions may carry it as
    literals and joins may broadcast its tables.
    """

    spark: SparkSession
    version: str
    modalities: tuple[str, ...]
    modality_datatypes: dict[str, tuple[str, ...]]
    # name -> (display name, description)
    datatypes: dict[str, tuple[str, str]]
    # name -> (short name, description, format)
    entities: dict[str, tuple[str, str, str]]
    entity_order: tuple[str, ...]
    rules: tuple[Rule, ...]
    # name -> (display name, description)
    suffixes: dict[str, tuple[str, str]]

    def raw_rules(self, datatype: str) -> list[Rule]:
        return [r for r in self.rules if r.source == "raw" and r.datatype == datatype]

    def datatype_names(self) -> list[str]:
        return _in_order(d for members in self.modality_datatypes.values() for d in members)

    def short_name(self, entity: str) -> str:
        return self.entities[entity][0] if entity in self.entities else entity

    def short_order(self) -> list[str]:
        return [self.short_name(e) for e in self.entity_order]


def _in_order(values: Iterable[str]) -> list[str]:
    """Distinct values, first occurrence first."""
    return list(dict.fromkeys(values))


# --- building a catalog ---------------------------------------------------------------------


def seed_catalog(spark: SparkSession) -> Catalog:
    return Catalog(
        spark=spark,
        version="seed",
        modalities=("mri",),
        modality_datatypes={"mri": tuple(MRI_DATATYPES)},
        datatypes={d: (d, "") for d in MRI_DATATYPES},
        entities={e: (ENTITY_SHORT[e], "", "string") for e in ENTITY_ORDER},
        entity_order=tuple(ENTITY_ORDER),
        rules=tuple(
            Rule(
                "raw",
                d,
                d,
                tuple(DATATYPE_SUFFIXES[d]),
                tuple(DATATYPE_ENTITIES[d]),
                tuple(naming.EXTENSIONS),
            )
            for d in MRI_DATATYPES
        ),
        suffixes={s: (s, "") for names in DATATYPE_SUFFIXES.values() for s in names},
    )


_NAMED = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("order", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
# Suffix and entity lists come as a list or as a mapping, so they are read as text first.
_RULE = T.StructType(
    [
        T.StructField("suffixes", T.StringType()),
        T.StructField("entities", T.StringType()),
        T.StructField("extensions", T.StringType()),
        T.StructField("datatypes", T.StringType()),
    ]
)
CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField(
            "objects",
            T.StructType(
                [
                    T.StructField("entities", T.MapType(T.StringType(), _NAMED)),
                    T.StructField("modalities", T.MapType(T.StringType(), _NAMED)),
                    T.StructField("datatypes", T.MapType(T.StringType(), _NAMED)),
                    T.StructField("suffixes", T.MapType(T.StringType(), _NAMED)),
                ]
            ),
        ),
        T.StructField(
            "rules",
            T.StructType(
                [
                    T.StructField("entities", T.ArrayType(T.StringType())),
                    T.StructField(
                        "modalities",
                        T.MapType(
                            T.StringType(),
                            T.StructType(
                                [T.StructField("datatypes", T.ArrayType(T.StringType()))]
                            ),
                        ),
                    ),
                    T.StructField(
                        "files",
                        T.StructType(
                            [
                                T.StructField(
                                    "raw",
                                    T.MapType(T.StringType(), T.MapType(T.StringType(), _RULE)),
                                ),
                                T.StructField("common", T.StringType()),
                            ]
                        ),
                    ),
                ]
            ),
        ),
    ]
)


def _names(text: Column, of_mapping: str) -> Column:
    """List in a JSON text; of a mapping, its ``keys`` or ``values``."""
    mapping = F.from_json(text, "map<string,string>")
    take = F.map_keys(mapping) if of_mapping == "keys" else F.map_values(mapping)
    return (
        F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))
        .when(text.rlike(r"^\s*\{"), take)
        .otherwise(F.array().cast("array<string>"))
    )


def entry_rows(tree: DataFrame, *lead: str) -> DataFrame:
    """One row per modality, datatype, entity and suffix of catalog documents, after columns ``lead``."""

    def named(kind: str, map_column: str) -> DataFrame:
        entries = F.posexplode(F.map_entries(map_column)).alias("pos", "e")
        return tree.select(*lead, entries).select(
            *lead,
            F.lit(kind).alias("kind"),
            "pos",
            F.col("e.key").alias("name"),
            F.col("e.value.display_name").alias("display_name"),
            F.col("e.value.name").alias("short_name"),
            F.col("e.value.description").alias("description"),
            F.col("e.value.format").alias("format"),
            F.col("e.value.order").try_cast("int").alias("rank"),
            F.col("e.value.value").alias("value"),
        )

    return (
        named("modality", "objects.modalities")
        .unionByName(named("datatype", "objects.datatypes"))
        .unionByName(named("entity", "objects.entities"))
        .unionByName(named("suffix", "objects.suffixes"))
    )


def rule_rows(tree: DataFrame, *lead: str) -> DataFrame:
    """One row per rule and datatype of catalog documents, after columns ``lead``."""
    no_names = F.array().cast("array<string>")
    raw = (
        tree.select(*lead, F.posexplode(F.map_entries("rules.files.raw")).alias("outer", "d"))
        # The rules of a datatype are a column of their own, else each exploded row would carry them all.
        .select(*lead, "outer", F.col("d.key").alias("datatype"), F.col("d.value").alias("named"))
        .select(
            *lead,
            "outer",
            "datatype",
            F.posexplode(F.map_entries("named")).alias("inner", "r"),
        )
        .select(
            *lead,
            F.lit("raw").alias("source"),
            F.col("r.key").alias("rule_name"),
            "outer",
            "inner",
            "datatype",
            _names(F.col("r.value.suffixes"), "values").alias("suffixes"),
            # A list of entities is not a rule's entity mapping and is left out.
            F.when(
                F.col("r.value.entities").rlike(r"^\s*\{"),
                _names(F.col("r.value.entities"), "keys"),
            )
            .otherwise(no_names)
            .alias("entities"),
            _names(F.col("r.value.extensions"), "values").alias("extensions"),
        )
    )
    # Shared rules come as a list or as a mapping; either way each is one rule per datatype.
    common_text = F.col("rules.files.common")
    common_rules = F.when(
        common_text.rlike(r"^\s*\["), F.from_json(common_text, T.ArrayType(_RULE))
    ).when(
        common_text.rlike(r"^\s*\{"),
        F.map_values(F.from_json(common_text, T.MapType(T.StringType(), _RULE))),
    )
    common = (
        tree.select(*lead, F.posexplode(common_rules).alias("outer", "r"))
        .select(
            *lead,
            "outer",
            "r",
            F.posexplode(_names(F.col("r.datatypes"), "values")).alias("inner", "d"),
        )
        .select(
            *lead,
            F.lit("common").alias("source"),
            F.concat(F.lit("common_"), F.col("outer").cast("string")).alias("rule_name"),
            "outer",
            "inner",
            F.col("d").alias("datatype"),
            _names(F.col("r.suffixes"), "values").alias("suffixes"),
            _names(F.col("r.entities"), "keys").alias("entities"),
            _names(F.col("r.extensions"), "values").alias("extensions"),
        )
    )
    return raw.unionByName(common)


def load_catalog(spark: SparkSession, path: str, max_rows: int = MAX_CATALOG_ROWS) -> Catalog:
    """Catalog from one JSON document.

    Parsing and flattening run in Spark; the resulting vocabulary is fetched after a check that
    it has no more than ``max_rows`` rules and names.
    """
    tree = spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path)
    rules = _bounded(rule_rows(tree), max_rows)
    vocabulary = sorted(_bounded(entry_rows(tree), max_rows), key=lambda r: r["pos"])
    # One document is one row; its lists were bounded by the reader.
    top = tree.select(
        "schema_version", "rules.entities", F.col("rules.modalities").alias("modalities")
    ).first()
    declared = {
        name: tuple(value["datatypes"] or ())
        for name, value in ((top and top["modalities"]) or {}).items()
    }
    if not declared.get("mri"):
        declared["mri"] = tuple(MRI_DATATYPES)
    entities = [r for r in vocabulary if r["kind"] == "entity"]
    ranked = sorted((r for r in entities if r["rank"] is not None), key=lambda r: r["rank"])
    order = (top and top["entities"]) or [r["name"] for r in ranked] or ENTITY_ORDER
    rules.sort(key=lambda r: (r["source"] != "raw", r["outer"], r["inner"]))
    return Catalog(
        spark=spark,
        version=(top and top["schema_version"]) or "unknown",
        modalities=tuple(r["name"] for r in vocabulary if r["kind"] == "modality"),
        modality_datatypes=declared,
        datatypes={
            r["name"]: (r["display_name"] or r["name"], r["description"] or "")
            for r in vocabulary
            if r["kind"] == "datatype"
        },
        entities={
            r["name"]: (
                r["short_name"] or r["name"],
                r["description"] or "",
                r["format"] or "string",
            )
            for r in entities
        },
        entity_order=tuple(order),
        rules=tuple(
            Rule(
                r["source"],
                r["rule_name"],
                r["datatype"],
                tuple(r["suffixes"]),
                tuple(r["entities"]),
                tuple(r["extensions"]),
            )
            for r in rules
        ),
        suffixes={
            # A suffix's entry says its name in ``value``; its key is the fallback.
            r["value"] or r["name"]: (r["display_name"] or r["name"], r["description"] or "")
            for r in vocabulary
            if r["kind"] == "suffix"
        },
    )


def _bounded(df: DataFrame, max_rows: int) -> list:
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a catalog may not have more than {max_rows} entries")
    return rows


def is_version(text: Column) -> Column:
    return text.rlike(VERSION_PATTERN)


# --- vocabulary -----------------------------------------------------------------------------


def mri_datatypes(catalog: Catalog) -> list[str]:
    return list(catalog.modality_datatypes.get("mri", MRI_DATATYPES))


def valid_suffixes(catalog: Catalog, datatype: str) -> list[str]:
    """Suffixes of a datatype, first occurrence first; ``mri`` unites its datatypes."""
    members = mri_datatypes(catalog) if datatype == "mri" else [datatype]
    return _in_order(s for d in members for rule in catalog.raw_rules(d) for s in rule.suffixes)


def valid_entities(catalog: Catalog, datatype: str) -> list[str]:
    rules = catalog.raw_rules(datatype)
    if not rules:
        raise ValueError(f"the catalog has no datatype '{datatype}'")
    return _in_order(e for rule in rules for e in rule.entities)


def default_modality(catalog: Catalog) -> str:
    if not catalog.modalities:
        raise ValueError("the catalog has no modalities")
    return catalog.modalities[0]


def default_suffix(catalog: Catalog) -> str:
    suffixes = valid_suffixes(catalog, default_modality(catalog))
    if not suffixes:
        raise ValueError(f"no suffix for modality '{default_modality(catalog)}'")
    return suffixes[0]


# --- dimension tables -------------------------------------------------------------------------


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _texts(values: Iterable[str]) -> str:
    return f"CAST(array({', '.join(_text(v) for v in values)}) AS array<string>)"


def _table(catalog: Catalog, columns: str, rows: list[str]) -> DataFrame:
    """Literal rows: the optimizer knows their exact size and broadcasts them by itself."""
    if not rows:
        raise ValueError("the catalog has no rules")
    return catalog.spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})")


def datatype_suffixes(catalog: Catalog) -> DataFrame:
    """``(datatype, suffix, pos)`` with ``mri`` as one more datatype."""
    names = _in_order(["mri", *(r.datatype for r in catalog.rules)])
    return _table(
        catalog,
        "datatype, suffix, pos",
        [
            f"({_text(d)}, {_text(s)}, {i})"
            for d in names
            for i, s in enumerate(valid_suffixes(catalog, d))
        ],
    )


def datatype_entities(catalog: Catalog) -> DataFrame:
    """``(datatype, entity, short_name, pos)``."""
    names = _in_order(r.datatype for r in catalog.rules if r.source == "raw")
    return _table(
        catalog,
        "datatype, entity, short_name, pos",
        [
            f"({_text(d)}, {_text(e)}, {_text(catalog.short_name(e))}, {i})"
            for d in names
            for i, e in enumerate(valid_entities(catalog, d))
        ],
    )


def rules_table(catalog: Catalog, datatype: str | None = None) -> DataFrame:
    """All rules, or those of one datatype, shared rules included."""
    table = _table(
        catalog,
        "source, rule_name, pos, datatype, suffixes, entities, short_names, extensions",
        [
            f"({_text(r.source)}, {_text(r.rule_name)}, {i}, {_text(r.datatype)}, "
            f"{_texts(r.suffixes)}, {_texts(r.entities)}, "
            f"{_texts(catalog.short_name(e) for e in r.entities)}, {_texts(r.extensions)})"
            for i, r in enumerate(catalog.rules)
        ],
    )
    return table if datatype is None else table.where(F.col("datatype") == datatype)


def entity_suffix_combinations(catalog: Catalog) -> DataFrame:
    """One row per rule and suffix with the entities that may go with it."""
    return rules_table(catalog).select(
        "datatype",
        "rule_name",
        "pos",
        F.explode("suffixes").alias("suffix"),
        "entities",
        "short_names",
    )


def datatype_rollup(catalog: Catalog) -> dict[str, dict]:
    """Datatype -> name, description and sorted suffixes, as prompts show them."""
    rollup = {}
    for datatype in mri_datatypes(catalog):
        name, description = catalog.datatypes.get(datatype, (datatype, ""))
        rollup[datatype] = {
            "name": name,
            "description": description,
            "suffixes": sorted(valid_suffixes(catalog, datatype)),
        }
    return rollup


def entity_rollup(catalog: Catalog) -> dict[str, dict]:
    return {
        entity: {"name": short, "description": description, "format": form}
        for entity, (short, description, form) in catalog.entities.items()
    }


# --- naming patterns --------------------------------------------------------------------------


def _pattern_rows(catalog: Catalog, entity_sets: Column) -> DataFrame:
    rule_suffixes = rules_table(catalog).select(
        "datatype",
        F.col("pos").alias("rule_pos"),
        F.posexplode("suffixes").alias("suffix_pos", "suffix"),
        "entities",
    )
    return rule_suffixes.select(
        "datatype",
        "suffix",
        "rule_pos",
        "suffix_pos",
        F.posexplode(entity_sets).alias("set_pos", "entity_set"),
    )


def _finish_patterns(rows: DataFrame, catalog: Catalog, prefix: str) -> DataFrame:
    names = F.col("entity_set")
    lead = [F.lit(prefix)] if prefix else []
    key = F.concat_ws("_", *lead, F.col("datatype"), F.lower("suffix"), F.array_sort(names))
    entities = F.map_from_arrays(
        names, F.transform(names, lambda n: F.concat(F.lit("{"), n, F.lit("}")))
    )
    pattern = naming.path_template(
        F.col("datatype"), F.col("suffix"), entities, list(catalog.entity_order)
    )
    shaped = rows.select(
        key.alias("pattern_key"),
        "datatype",
        "suffix",
        F.array_join(F.array_sort(names), "_").alias("entity_key"),
        pattern.alias("pattern"),
        F.struct("rule_pos", "suffix_pos", "set_pos").alias("seen"),
    )
    # A later rule with the same key replaces an earlier one.
    return shaped.groupBy("pattern_key").agg(
        *[F.max_by(c, "seen").alias(c) for c in ("datatype", "suffix", "entity_key", "pattern")]
    )


def _free_entities(entities: Column) -> Column:
    return F.filter(entities, lambda e: ~e.isin("subject", "session"))


def _no_entities() -> Column:
    return F.array(F.array().cast("array<string>"))


def naming_patterns(catalog: Catalog) -> DataFrame:
    """Every datatype and suffix bare, and with each single entity."""
    singles = F.transform(_free_entities(F.col("entities")), lambda e: F.array(e))
    sets = F.concat(_no_entities(), singles)
    return _finish_patterns(_pattern_rows(catalog, sets), catalog, "")


def combined_naming_patterns(catalog: Catalog) -> DataFrame:
    """As ``naming_patterns`` plus every pair and triple of a rule's entities.

    Subsets are taken of the full entity list and then lose subject and session, so a triple
    with one of them yields a pair again; equal keys collapse. The work per rule is bounded by
    the rule's own entity count.
    """
    free = _free_entities(F.col("entities"))
    singles = F.transform(free, lambda e: F.array(e))

    def later(i: Column) -> Column:
        return F.slice(free, i + F.lit(2), F.size(free))

    pairs = F.flatten(
        F.transform(free, lambda a, i: F.transform(later(i), lambda b: F.array(a, b)))
    )
    triples = F.flatten(
        F.flatten(
            F.transform(
                free,
                lambda a, i: F.transform(
                    free,
                    lambda b, j: F.when(
                        j > i, F.transform(later(j), lambda c: F.array(a, b, c))
                    ).otherwise(F.array().cast("array<array<string>>")),
                ),
            )
        )
    )
    # Three-element subsets exist only for rules with three or more entities.
    sets = F.concat(_no_entities(), singles, pairs, triples)
    return _finish_patterns(_pattern_rows(catalog, sets), catalog, "full")


# --- holding paths against the catalog ----------------------------------------------------------


def parse_paths(paths: DataFrame) -> DataFrame:
    """``datatype``, ``suffix`` and file-name entities of every path."""
    return naming.with_path_fields(paths).drop(*naming.PATH_HELPERS)


def with_suffix_validity(named: DataFrame, catalog: Catalog) -> DataFrame:
    """Add ``suffix_valid`` to rows that carry ``datatype`` and ``suffix``."""
    dimension = datatype_suffixes(catalog).select(
        "datatype", "suffix", F.lit(True).alias("suffix_valid")
    )
    return named.join(dimension, ["datatype", "suffix"], "left").fillna(
        False, subset=["suffix_valid"]
    )


def illegal_entities(parsed: DataFrame, catalog: Catalog) -> DataFrame:
    """One row per path and entity that its datatype does not allow."""
    exploded = parsed.select("*", F.explode("entity_keys").alias("short_name"))
    return exploded.join(datatype_entities(catalog), ["datatype", "short_name"], "left_anti")


def entity_order_breaks(parsed: DataFrame, catalog: Catalog) -> DataFrame:
    """Paths whose known entities do not follow the catalog order.

    The order is looked up inside the row: an entity list is a handful of names, so no
    exploding and regrouping is needed.
    """
    order = F.array(*[F.lit(name) for name in catalog.short_order()])
    ranks = F.filter(
        F.transform("entity_keys", lambda k: F.array_position(order, k)),
        lambda r: r > 0,
    )
    return parsed.withColumn("ranks", ranks).select(
        *parsed.columns, (F.col("ranks") == F.array_sort("ranks")).alias("in_order")
    )


def combination_check(parsed: DataFrame, catalog: Catalog) -> DataFrame:
    """Whether some rule allows a path's suffix together with all its entities."""
    keys = ["datatype", "suffix", "members"]
    placed = parsed.withColumn("members", F.array_sort(F.array_distinct("entity_keys")))
    allowed = entity_suffix_combinations(catalog).withColumn("members", F.col("short_names"))
    found = contained(placed, allowed, ["datatype", "suffix"])
    return placed.join(found, keys, "left").select(
        *parsed.columns,
        F.when(F.col("verdict") == "held", F.lit("legal"))
        .when(F.col("verdict") == "not held", F.lit("illegal"))
        .otherwise(F.lit("unknown suffix"))
        .alias("combination"),
    )


def _long_names(parsed: DataFrame, catalog: Catalog) -> DataFrame:
    """Sorted long names of a path's free entities as one key, looked up inside the row."""
    names = F.create_map(
        *[F.lit(x) for e, (short, _, _) in catalog.entities.items() for x in (short, e)]
    )
    used = F.transform("entity_keys", lambda k: F.coalesce(F.try_element_at(names, k), k))
    key = F.array_join(F.array_sort(F.array_distinct(_free_entities(used))), "_")
    return parsed.withColumn("entity_key", key)


def pattern_coverage(parsed: DataFrame, patterns: DataFrame, catalog: Catalog) -> DataFrame:
    """Paths per pattern, with patterns nobody uses and shapes no pattern covers."""
    observed = (
        _long_names(parsed, catalog)
        .groupBy("datatype", "suffix", "entity_key")
        .agg(F.count("*").alias("n_paths"))
    )
    joined = observed.join(
        patterns.select("datatype", "suffix", "entity_key", "pattern_key", "pattern"),
        ["datatype", "suffix", "entity_key"],
        "full_outer",
    )
    return joined.select(
        "datatype",
        "suffix",
        "entity_key",
        "pattern_key",
        "pattern",
        F.coalesce("n_paths", F.lit(0)).alias("n_paths"),
        F.when(F.col("pattern_key").isNull(), F.lit("uncovered"))
        .when(F.col("n_paths").isNull(), F.lit("unused"))
        .otherwise(F.lit("covered"))
        .alias("coverage"),
    )


def validate_paths(paths: DataFrame, catalog: Catalog, strict_reference: bool = False) -> DataFrame:
    """Add ``check``: valid, errors, warnings, entities.

    ``strict_reference`` compares datatypes with modality names and short entity keys with long
    names, which warns on every ordinary path.
    """
    known = list(catalog.modalities) if strict_reference else catalog.datatype_names()
    names = list(catalog.entities) if strict_reference else catalog.short_order()
    suffixes = {
        d: valid_suffixes(catalog, d) for d in _in_order(["mri", *catalog.datatype_names()])
    }
    checked = naming.with_path_fields(paths).withColumn(
        "check", naming.check_path(known, suffixes, names)
    )
    return checked.select(*paths.columns, "check")
