"""Catalogs of several versions as tables, and paths held against the version each of them asks for.

Nothing is fetched to the driver and no size is limited: a version's vocabulary is rows, its checks are
joins. ``catalog.load_catalog`` remains for prompts and expressions, which carry a small vocabulary as
literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators import catalog as cat
from seriesloom.operators.containment import contained
from seriesloom.staging import stage

LATEST = "latest"
# Names of a source that is no numbered version.
BRANCHES = ("master",)


@dataclass(frozen=True)
class CatalogTables:
    """``versions``: version, major, minor, patch. ``entries`` and ``rules``: as their functions in
    ``catalog``, after ``version`` and ``document``. ``members``: version, modality, datatype."""

    versions: DataFrame
    entries: DataFrame
    rules: DataFrame
    members: DataFrame


def load_versions(spark: SparkSession, *paths: str, lines: bool = False) -> CatalogTables:
    """Tables of all catalog documents below ``paths``.

    Each file is one document, or with ``lines`` each line. Documents of one version are united, so a
    large catalog may come in many. A document without ``schema_version`` is named by its file. Texts
    that are no JSON object give no rows.
    """
    read = spark.read.schema(cat.CATALOG_SCHEMA).option("multiLine", not lines).json(list(paths))
    file = F.col("_metadata.file_path")
    name = F.regexp_replace(F.substring_index(file, "/", -1), r"\.json$", "")
    tree = read.select(
        F.coalesce("schema_version", name).alias("version"),
        file.alias("document"),
        "objects",
        "rules",
    ).where(F.col("objects").isNotNull() | F.col("rules").isNotNull())
    lead = ("version", "document")
    declared = tree.select("version", F.explode("rules.modalities").alias("modality", "m")).select(
        "version", "modality", F.explode("m.datatypes").alias("datatype")
    )
    versions = stage(_numbered(tree.select("version").distinct()), "catalog-versions")
    members = stage(declared.distinct(), "catalog-members")
    # A version that does not say what belongs to it has the usual datatypes.
    usual = F.explode(F.array(*[F.lit(d) for d in cat.MRI_DATATYPES])).alias("datatype")
    silent = versions.join(members.where("modality = 'mri'"), "version", "left_anti")
    return CatalogTables(
        versions=versions,
        entries=stage(cat.entry_rows(tree, *lead), "catalog-entries"),
        rules=stage(cat.rule_rows(tree, *lead), "catalog-rules"),
        members=members.unionByName(silent.select("version", F.lit("mri").alias("modality"), usual)),
    )


def _numbered(versions: DataFrame) -> DataFrame:
    def part(i: int):
        number = F.regexp_extract("version", r"^(\d+)\.(\d+)\.(\d+)", i)
        return F.when(cat.is_version(F.col("version")), number.try_cast("decimal(38,0)"))

    return versions.select(
        "version", part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")
    )


def choose_versions(asked: DataFrame, tables: CatalogTables) -> DataFrame:
    """Distinct ``asked`` names with the ``version`` that answers them.

    ``latest``, nulls and names that are neither a number nor a branch get the greatest version by
    major, minor and patch; of equal numbers, as of ``1.9.0`` and ``1.9.0-rc``, the shorter name, then
    the smaller. A number or branch that was not loaded gets null. Without numbered versions, so does
    ``latest``.
    """
    number = F.struct("major", "minor", "patch", (-F.length("version")).alias("brief"))
    numbered = tables.versions.where(F.col("major").isNotNull())
    newest = (
        numbered.groupBy("major", "minor", "patch", F.length("version").alias("size"))
        .agg(F.min("version").alias("version"))
        .agg(F.max_by("version", number).alias("version"))
        .select(F.lit(LATEST).alias("source"), "version")
    )
    loaded = tables.versions.where(F.col("version") != LATEST).select(
        F.col("version").alias("source"), "version"
    )
    named = cat.is_version(F.col("asked")) | F.col("asked").isin(*BRANCHES)
    return (
        asked.select("asked")
        .distinct()
        .withColumn("source", F.when(named, F.col("asked")).otherwise(F.lit(LATEST)))
        .join(loaded.unionByName(newest), "source", "left")
        .select("asked", "version")
    )


# --- dimensions -------------------------------------------------------------------------------


_SEEN = ("document", "outer", "inner", "pos")


def suffixes(tables: CatalogTables) -> DataFrame:
    """``(version, datatype, suffix, seen)``; ``seen`` orders by first place. ``mri`` unites its datatypes."""
    raw = tables.rules.where("source = 'raw'").select(
        "version",
        "document",
        "outer",
        "inner",
        "datatype",
        F.posexplode("suffixes").alias("pos", "suffix"),
    )
    mri = tables.members.where("modality = 'mri'").select("version", "datatype")
    united = raw.join(mri, ["version", "datatype"], "left_semi").withColumn("datatype", F.lit("mri"))
    return (
        raw.where("datatype <> 'mri'")
        .unionByName(united)
        .groupBy("version", "datatype", "suffix")
        .agg(F.min(F.struct(*_SEEN)).alias("seen"))
    )


def _short_names(tables: CatalogTables) -> DataFrame:
    """``(version, entity, short_name)``; of several documents' entries the first document's."""
    return (
        tables.entries.where("kind = 'entity'")
        .groupBy("version", F.col("name").alias("entity"))
        .agg(F.min(F.struct("document", "pos", "short_name")).alias("first"))
        .select("version", "entity", "first.short_name")
    )


def _raw_rules(tables: CatalogTables) -> DataFrame:
    """Rules with ``short_names`` beside ``entities``, looked up once per distinct list of entities."""
    no_names = F.array().cast("array<string>")
    raw = tables.rules.where("source = 'raw'").withColumn("entities", F.coalesce("entities", no_names))
    lists = raw.select("version", "entities").distinct()
    short = (
        lists.select("*", F.posexplode_outer("entities").alias("pos", "entity"))
        .join(_short_names(tables), ["version", "entity"], "left")
        .groupBy("version", "entities")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("pos", F.coalesce("short_name", "entity").alias("name")))
            ).alias("placed")
        )
        .select(
            "version",
            "entities",
            F.filter("placed.name", lambda n: n.isNotNull()).alias("short_names"),
        )
    )
    return raw.join(short, ["version", "entities"])


def entities(tables: CatalogTables) -> DataFrame:
    """``(version, datatype, entity, short_name, seen)``."""
    rows = _raw_rules(tables).select(
        "version",
        "document",
        "outer",
        "inner",
        "datatype",
        F.posexplode(F.arrays_zip("entities", "short_names")).alias("pos", "e"),
    )
    return (
        rows.groupBy(
            "version",
            "datatype",
            F.col("e.entities").alias("entity"),
            F.col("e.short_names").alias("short_name"),
        )
        .agg(F.min(F.struct(*_SEEN)).alias("seen"))
    )


def allowed_sets(tables: CatalogTables) -> DataFrame:
    """``(version, datatype, suffix, members)``: short names that one rule allows with its suffixes."""
    return (
        _raw_rules(tables)
        .select(
            "version",
            "datatype",
            F.explode("suffixes").alias("suffix"),
            F.array_sort(F.array_distinct("short_names")).alias("members"),
        )
        .distinct()
    )


def rules_of(tables: CatalogTables, datatype: str) -> DataFrame:
    """A datatype's rules in every version, shared ones included; an unknown datatype has none."""
    return tables.rules.where(F.col("datatype") == datatype)


# --- checks -----------------------------------------------------------------------------------


def check_paths(parsed: DataFrame, tables: CatalogTables) -> DataFrame:
    """Add ``version, suffix_valid, illegal_entities, combination`` to parsed paths with ``asked``.

    Paths without a version that answers them have null checks. ``illegal_entities`` are the sorted
    short names that no rule of the datatype allows. Paths are first reduced to their distinct shapes
    on the map side, so the checks work on those and the paths meet the result in one join, which is a
    broadcast where the shapes are few and else left to adaptive skew handling of common shapes.
    """
    taken = {"version", "members", "named", "verdict", "illegal", "listed"} & set(parsed.columns)
    if taken:
        raise ValueError(f"rename columns {sorted(taken)}, which the checks use")
    answered = choose_versions(parsed, tables).withColumnRenamed("asked", "named")
    shape = F.array_sort(F.array_distinct("entity_keys"))
    keys = ["version", "datatype", "suffix", "members"]
    paths = (
        parsed.withColumn("members", shape)
        .join(answered, F.col("asked").eqNullSafe(F.col("named")), "left")
        .drop("named")
    )
    shapes = stage(paths.select(*keys).dropna(subset=keys).distinct(), "path-shapes")
    allowed = entities(tables).select(
        "version", "datatype", F.col("short_name").alias("member"), F.lit(True).alias("allowed")
    )
    illegal = (
        shapes.select("*", F.explode("members").alias("member"))
        .join(allowed.distinct(), ["version", "datatype", "member"], "left_anti")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("member")).alias("illegal"))
    )
    known = suffixes(tables).select("version", "datatype", "suffix", F.lit(True).alias("listed"))
    verdicts = (
        contained(shapes, allowed_sets(tables), ["version", "datatype", "suffix"])
        .join(illegal, keys, "left")
        .join(known, ["version", "datatype", "suffix"], "left")
    )
    # Every shape without a null has a verdict; the others cannot be in a catalog.
    asked_for = F.col("version").isNotNull()
    no_names = F.array().cast("array<string>")
    known_verdict = (
        F.when(F.col("verdict") == "held", F.lit("legal"))
        .when(F.col("verdict") == "not held", F.lit("illegal"))
        .otherwise(F.lit("unknown suffix"))
    )
    unplaced = F.when(F.col("verdict").isNull(), F.col("members")).otherwise(no_names)
    return paths.join(verdicts, keys, "left").select(
        *parsed.columns,
        "version",
        F.when(asked_for, F.coalesce("listed", F.lit(False))).alias("suffix_valid"),
        F.when(asked_for, F.coalesce("illegal", unplaced)).alias("illegal_entities"),
        F.when(asked_for, known_verdict).alias("combination"),
    )
