"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators import catalog as cat
from seriesloom.operators import (
    answers,
    classify,
    grouping,
    incremental,
    inference,
    postings,
    profile,
    programs,
    rules,
    versions,
)
from seriesloom.plans import views
from seriesloom.schema import SERIES_SCHEMA
from seriesloom.sources import listing, sinks, tables
from seriesloom.staging import new_path, stage

VARIANT_CONTEXT = "T2w scans: use _rec-norm_ for NORM, judged by image_type"
DERIVED_CONTEXT = "keep derived series apart"
MOTION_CONTEXT = "keep motion corrected series apart"

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def shown(entities: Column) -> Column:
    """A map as text, so that results compare by value."""
    entries = F.transform(
        F.map_entries(entities), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.array_join(F.array_sort(entries), ",")


# --- inputs ---------------------------------------------------------------------------------


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.group_series(views.series(spark, sf_dir))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered groups as a staged table; both steps are read more than once downstream."""
    groups = stage(_groups(spark, sf_dir), "groups")
    return stage(grouping.number_groups(groups), "numbered")


def _batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.assign_batches(_numbered(spark, sf_dir))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.map_by_keywords(_groups(spark, sf_dir), cat.seed_catalog(spark))


def _mapped_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.map_by_keywords(_numbered(spark, sf_dir), cat.seed_catalog(spark))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.parse_paths(views.paths(spark, sf_dir))


# --- sources ----------------------------------------------------------------------------------


def _column_sets(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The series as two kinds of table that lack a column each, with repeated rows."""
    series = views.series(spark, sf_dir).drop("row_ord")
    first, second = series.drop("image_type"), series.drop("sequence_name")
    return [first, second, first.where("series_id % 10 = 0")]


@query
def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    united = tables.consolidate(_column_sets(spark, sf_dir))
    return tables.with_provenance(tables.drop_repeats(united))


@query
def scanned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables written as tab-separated text and read back by header."""
    root = new_path(spark, "tables")
    for i, table in enumerate(_column_sets(spark, sf_dir)):
        sinks.write_table(table, f"{root}/{i}")
    scanned = tables.read_session_tables(spark, root, pattern="*.csv")
    return tables.drop_repeats(scanned).select(
        *[f.name for f in SERIES_SCHEMA.fields if f.name != "total_files_till_now"]
    )


@query
def written_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversation texts written as a table and read back, quotes and line breaks included."""
    path = new_path(spark, "texts")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    marks = F.concat(F.lit('"'), "role", F.lit('"\t"tab" and \\\n"'), "text", F.lit('"'))
    sinks.write_table(
        given.select(F.concat_ws("-", "conv_id", "turn").alias("series_id"), marks.alias("note")), path
    )
    return tables.read_table(spark, path).select("series_id", "note")


@query
def split_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversation texts as one table of two files, scanned by byte ranges.

    The second cell holds tabs and line breaks in quotes, the third quotes inside of plain text.
    """
    path = new_path(spark, "turns")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = F.concat_ws("-", "conv_id", "turn")
    tall = F.concat(F.lit("5\" "), F.col("role"))
    cells = given.select(
        key.alias("series_id"),
        F.concat("text", F.lit("\n\t\n"), "role").alias("note"),
        tall.alias("protocol_name"),
    )
    sinks.write_table(cells.repartition(2, "series_id"), path)
    united = tables.read_session_tables(spark, path, pattern="*.csv")
    return united.select(
        "series_id", F.get_json_object("extra", "$[0].value").alias("note"), "protocol_name"
    )


@query
def ingested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tables that were read from files: no row id, series ids repeat over subjects."""
    root = new_path(spark, "tables")
    series = views.series(spark, sf_dir).drop("row_ord")
    sinks.write_table(series.withColumn("series_id", F.expr("series_id % 50")), root)
    scanned = tables.read_session_tables(spark, root, pattern="*.csv").drop("row_ord")
    return grouping.group_series(scanned).select(
        "group_id",
        "series_count",
        "representative_series_id",
        "total_files",
        "subject",
        "session",
        "example_dcm_file",
        "dcm_dir_name",
    )


@query
def conversation_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The program check on texts that were not written for it."""
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    checked = inference.check_programs(texts.withColumnRenamed("text", "response"))
    return checked.select(
        "conv_id", "turn", "has_imports", "has_create_key", "has_infotodict", "accepted"
    )


@query
def subject_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.discover_sessions(views.paths(spark, sf_dir))


@query
def numbered_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories named by numbers: customer, order number modulo 3 unless 0, file."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    part = F.col("o_orderkey") % 3
    path = F.concat(
        F.col("o_custkey").cast("string"),
        F.lit("/"),
        F.when(part == 0, "").otherwise(F.concat(part.cast("string"), F.lit("/"))),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".dcm")),
    )
    return listing.discover_sessions(orders.select(path.alias("path")))


@query
def flat_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without any directory are one subject."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return listing.discover_sessions(
        orders.select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"))
    )


@query
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.fingerprints(views.paths(spark, sf_dir))


@query
def changed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that gained files since the listing of 1 January 2000."""
    files = views.paths(spark, sf_dir)
    stored = listing.fingerprints(files.where("modificationTime < TIMESTAMP'2000-01-01'"))
    return listing.change_report(listing.fingerprints(files), stored)


# --- profile ----------------------------------------------------------------------------------


@query
def profile_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.overview(views.series(spark, sf_dir)).select(
        "study", "n_subjects", "n_sessions", "n_series"
    )


@query
def profile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.overview(views.series(spark, sf_dir)).select(
        "study",
        "n_matrix_sizes",
        "dim3_min",
        "dim3_max",
        "dim4_min",
        "dim4_max",
        "TR_min",
        "TR_max",
        "TE_min",
        "TE_max",
    )


@query
def profile_moco(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.overview(views.series(spark, sf_dir)).select(
        "study", "n_original", "n_motion_corrected"
    )


@query
def profile_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_protocols(views.series(spark, sf_dir))


@query
def series_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.series_total(views.series(spark, sf_dir))


# --- grouping ---------------------------------------------------------------------------------


@query
def series_coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.coerce_series(views.series(spark, sf_dir)).select(
        "series_id", "dim1", "dim2", "dim3", "dim4", "TR", "TE", "is_derived", "is_motion_corrected"
    )


@query
def series_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.by_popularity(_groups(spark, sf_dir))


@query
def series_groups_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = grouping.group_series(views.series(spark, sf_dir), null_keys="keep")
    return groups.drop("group_id")


@query
def numbered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select("study", "group_no", "group_id", "series_count")


@query
def group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.coverage(_groups(spark, sf_dir))


@query
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.top_groups(stage(_groups(spark, sf_dir), "groups"))


@query
def refreshed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all series from a store that was built a week before and then brought up to date.

    A directory is a day. Since then days were added, one gained files, and one is gone.
    """
    series = views.series(spark, sf_dir).withColumn("directory", F.col("session"))
    path, store = new_path(spark, "days"), new_path(spark, "group-store")
    cut = series.agg(F.date_sub(F.max(F.to_date("session")), 7).cast("string").alias("day")).scalar()
    earlier = (F.col("session") < cut) | ((F.col("session") == cut) & (F.col("series_id") % 2 == 0))
    gone = series.where(F.col("protocol_name") == "localizer").withColumns(
        {"directory": F.lit("gone"), "row_ord": -F.col("row_ord")}
    )
    trees = {"before": series.where(earlier).unionByName(gone), "after": series}
    for name, tree in trees.items():
        tree.repartition("directory").write.partitionBy("directory").parquet(f"{path}/{name}")
        table = spark.read.option("basePath", f"{path}/{name}").schema(
            tree.schema
        ).parquet(f"{path}/{name}")
        files = table.select(
            F.concat_ws("/", "directory", F.concat("series_id", F.lit(".dcm"))).alias("path"),
            F.col("series_files").alias("length"),
            F.col("session").alias("modificationTime"),
        )
        groups = incremental.refresh_groups(
            spark,
            store,
            stage(listing.fingerprints(files), "listed"),
            lambda changed, table=table: table.join(changed, "directory", "left_semi"),
        )
    return groups


# --- classification and names -------------------------------------------------------------------


@query
def classify_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.classify_series(views.series(spark, sf_dir), cat.seed_catalog(spark))
    return found.select(
        "series_id",
        "modality",
        "suffix",
        shown(F.col("entities")).alias("entities"),
        F.round("confidence", 4).alias("confidence"),
    )


@query
def path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = cat.seed_catalog(spark)
    found = classify.classify_series(views.series(spark, sf_dir), catalog)
    with_session = classify.with_path_template(found, catalog)
    short = classify.with_path_template(
        with_session.withColumnRenamed("path_template", "session_template"),
        catalog,
        include_session=False,
    )
    return short.select("series_id", "session_template", "path_template")


def _validated(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    checked = cat.validate_paths(views.paths(spark, sf_dir), cat.seed_catalog(spark), strict)
    return checked.select(
        "path_id",
        F.col("check.valid").alias("valid"),
        F.array_join("check.errors", "; ").alias("errors"),
        F.array_join("check.warnings", "; ").alias("warnings"),
        shown(F.col("check.entities")).alias("entities"),
    )


@query
def validate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir, strict=False)


@query
def validate_paths_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir, strict=True)


# --- catalog conformance ------------------------------------------------------------------------


@query
def suffix_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = cat.with_suffix_validity(_parsed(spark, sf_dir), cat.seed_catalog(spark))
    return checked.select("path_id", "datatype", "suffix", "suffix_valid")


@query
def entity_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.illegal_entities(_parsed(spark, sf_dir), cat.seed_catalog(spark)).select(
        "path_id", "datatype", "short_name"
    )


@query
def entity_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.entity_order_breaks(_parsed(spark, sf_dir), cat.seed_catalog(spark)).select(
        "path_id", "in_order"
    )


@query
def combination_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.combination_check(_parsed(spark, sf_dir), cat.seed_catalog(spark)).select(
        "path_id", "combination"
    )


@query
def pattern_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = cat.seed_catalog(spark)
    return cat.pattern_coverage(_parsed(spark, sf_dir), cat.naming_patterns(catalog), catalog)


@query
def pattern_coverage_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = cat.seed_catalog(spark)
    patterns = cat.combined_naming_patterns(catalog)
    return cat.pattern_coverage(_parsed(spark, sf_dir), patterns, catalog)


def _versions(spark: SparkSession, sf_dir: str) -> versions.CatalogTables:
    path = new_path(spark, "catalogs")
    views.catalog_documents(spark, sf_dir).write.text(path)
    return versions.load_versions(spark, path, lines=True)


@query
def versioned_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path against the version of the catalog that it asks for."""
    parsed = cat.parse_paths(views.asking_paths(spark, sf_dir))
    checked = versions.check_paths(parsed, _versions(spark, sf_dir))
    return checked.select(
        "path_id",
        "version",
        "suffix_valid",
        F.array_join("illegal_entities", ",").alias("illegal_entities"),
        "combination",
    )


@query
def catalog_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixes and entities of each version and datatype, ``mri`` included for suffixes."""
    loaded = _versions(spark, sf_dir)
    suffixes = versions.suffixes(loaded).select(
        "version", "datatype", F.lit("suffix").alias("kind"), F.col("suffix").alias("name")
    )
    entities = versions.entities(loaded).select(
        "version", "datatype", F.lit("entity").alias("kind"), F.col("short_name").alias("name")
    )
    return suffixes.unionByName(entities)


# --- mapping ------------------------------------------------------------------------------------


def _mapping_columns(mapped: DataFrame, *lead: str) -> DataFrame:
    return mapped.select(
        *lead,
        "bids_modality",
        "bids_suffix",
        shown(F.col("bids_entities")).alias("bids_entities"),
        F.round("bids_confidence", 4).alias("bids_confidence"),
        "bids_path",
        "mapping_source",
        "suffix_valid",
    )


@query
def fallback_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapping_columns(_mapped(spark, sf_dir), "group_id")


@query
def mapping_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.mapping_metrics(_mapped(spark, sf_dir))


@query
def mapping_by_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.mapping_by_modality(_mapped(spark, sf_dir))


@query
def top_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.top_mappings(_mapped(spark, sf_dir))


@query
def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.build_prompts(_batched(spark, sf_dir), cat.seed_catalog(spark))


@query
def sequence_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.sequence_prompts(_batched(spark, sf_dir))


@query
def model_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that gives no answers at all: every group falls back to the keyword rules."""
    mapped = inference.map_groups(
        _numbered(spark, sf_dir), cat.seed_catalog(spark), lambda: lambda prompts: []
    )
    return _mapping_columns(mapped, "group_id")


@query
def answer_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of asking over the conversations: all, those that failed, none."""

    def load():
        def answer(texts: list[str]) -> list[str | None]:
            if any(len(t) % 10 == 0 for t in texts):
                raise ValueError("refused")
            return [None if len(t) % 10 == 1 else f"{t.split(' ')[0]}:{len(t)}" for t in texts]

        return answer

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    prompts = turns.withColumnRenamed("text", "prompt")
    store = new_path(spark, "answers")
    for _ in range(3):
        answers.ask_missing(
            prompts, store, load, tasks=int(spark.conf.get("spark.sql.shuffle.partitions"))
        )
    found = answers.with_answers(prompts, store)
    return found.select("conv_id", "turn", "attempts", "answer", "error")


@query
def response_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    recovered = inference.recover_mappings(views.mapping_answers(_batched(spark, sf_dir)))
    return recovered.where(F.col("answer").isNotNull()).select(
        "batch_id",
        "pos",
        "answer.bids_modality",
        "answer.bids_suffix",
        shown(F.col("answer.bids_entities")).alias("bids_entities"),
        "answer.bids_confidence",
        "answer.bids_path",
    )


@query
def mapping_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = _batched(spark, sf_dir)
    recovered = inference.recover_mappings(views.mapping_answers(batched))
    mapped = inference.attach_mappings(batched, recovered, cat.seed_catalog(spark))
    return _mapping_columns(mapped, "group_id", "batch_id", "pos")


@query
def numbered_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.parse_numbered(views.numbered_answers(_batched(spark, sf_dir)))


@query
def code_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = inference.check_programs(views.program_answers(_batched(spark, sf_dir)))
    return checked.drop("response")


# --- rules --------------------------------------------------------------------------------------


def _rules(spark: SparkSession, sf_dir: str, context: str | None) -> DataFrame:
    return stage(rules.build_rules(_mapped_numbered(spark, sf_dir), context), "rules")


def _tuples(spark: SparkSession, sf_dir: str, context: str | None) -> DataFrame:
    return stage(rules.attribute_tuples(views.series(spark, sf_dir), context), "tuples")


def _matches(spark: SparkSession, sf_dir: str, context: str | None) -> DataFrame:
    return rules.apply_rules(
        _rules(spark, sf_dir, context),
        views.series(spark, sf_dir),
        _tuples(spark, sf_dir, context),
        context,
    ).select("key_name", "series_id")


@query
def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = rules.build_rules(_mapped_numbered(spark, sf_dir), VARIANT_CONTEXT)
    return built.select(
        "key_name",
        "bids_path",
        "variant",
        "protocol_name",
        "series_description",
        "sequence_name",
        "TR",
        "TE",
        "is_derived",
        "is_motion_corrected",
        "image_type",
        "series_count",
        "total_files",
        "representative_series_id",
        "description",
    )


@query
def rule_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = rules.build_rules(_mapped_numbered(spark, sf_dir), VARIANT_CONTEXT)
    return rules.with_conditions(built, VARIANT_CONTEXT).select(
        "key_name", "n_conditions", "condition", "filter"
    )


@query
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, None)


@query
def rule_matches_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, DERIVED_CONTEXT)


@query
def rule_matches_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, MOTION_CONTEXT)


@query
def rule_matches_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, VARIANT_CONTEXT)


@query
def rule_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.match_counts(
        _rules(spark, sf_dir, VARIANT_CONTEXT),
        _tuples(spark, sf_dir, VARIANT_CONTEXT),
        VARIANT_CONTEXT,
    ).select("key_name", "bids_path", "n_series")


@query
def rule_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = _mapped_numbered(spark, sf_dir)
    built = rules.build_rules(mapped, VARIANT_CONTEXT)
    return rules.program_lines(built, rules.study_summary(mapped), VARIANT_CONTEXT)


@query
def rule_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of each key in input order, by way of chunks of at most 100.

    A key without series has one row of position 0. Keys that ask for the same share one list.
    """
    table = _rules(spark, sf_dir, VARIANT_CONTEXT)
    shared = stage(rules.shared_keys(table, VARIANT_CONTEXT), "shared")
    own = stage(table.join(shared.where("key_name = shared_key"), ["study", "key_name"], "left_semi"), "own")
    matches = rules.apply_rules(
        own,
        views.series(spark, sf_dir),
        _tuples(spark, sf_dir, VARIANT_CONTEXT),
        VARIANT_CONTEXT,
    )
    lists = postings.shared_lists(postings.posting_lists(matches, own, chunk=100), shared)
    return postings.listed_matches(lists, chunk=100).select(
        "key_name",
        F.coalesce("position", F.lit(0)).alias("position"),
        F.coalesce(F.col("series_id").cast("string"), F.lit("")).alias("series_id"),
    )


def _program_rows(lines: DataFrame) -> DataFrame:
    block = F.concat_ws("/", "section", "group_no", "variant_no")
    return lines.withColumn("block", block)


@query
def program_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule program written, read back and applied: the matches of the rules it came from."""
    read, _ = programs.read_programs(_program_rows(rule_program(spark, sf_dir)))
    return programs.apply_programs(
        stage(read, "read"), stage(views.series(spark, sf_dir), "series")
    ).select("key_name", "series_id")


@query
def program_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs of many studies; some are damaged: other operators, tests without what follows."""
    groups = stage(grouping.group_series(_studies(spark, sf_dir)), "groups")
    numbered = stage(grouping.number_groups(groups), "numbered")
    mapped = inference.map_by_keywords(numbered, cat.seed_catalog(spark))
    lines = rules.program_lines(rules.build_rules(mapped), rules.study_summary(mapped))
    damaged = lines.withColumn(
        "line",
        F.when(F.col("study").contains("Brand#3"), F.replace("line", F.lit(" and "), F.lit(" or ")))
        .when(F.col("study").contains("Brand#5"), F.replace("line", F.lit("info["), F.lit("# info[")))
        .otherwise(F.col("line")),
    )
    return programs.read_programs(_program_rows(damaged))[1]


@query
def catch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.catch_all(views.series(spark, sf_dir))


def _studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series as many studies, one per protocol and sequence."""
    name = F.concat("protocol_name", F.lit("/"), F.coalesce("sequence_name", F.lit("none")))
    return views.series(spark, sf_dir).withColumn("study", name)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _studies(spark, sf_dir)
    groups = stage(grouping.group_series(series), "groups")
    numbered = stage(grouping.number_groups(groups), "numbered")
    mapped = inference.map_by_keywords(numbered, cat.seed_catalog(spark))
    programs = inference.check_programs(
        views.program_answers(inference.assign_batches(numbered).where("batch_id > 0"))
    )
    return rules.choose_sources(series, rules.build_rules(mapped, drop_unmapped=True), programs)


@query
def result_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which result each of many studies gets."""
    return _sources(spark, sf_dir)


@query
def catch_all_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catch-all of the studies that have neither rules nor an accepted program."""
    return rules.catch_all(_studies(spark, sf_dir), stage(_sources(spark, sf_dir), "sources"))


@query
def study_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering within each of many studies."""
    groups = stage(grouping.group_series(_studies(spark, sf_dir)), "groups")
    return grouping.number_groups(groups).groupBy("study").agg(
        F.max("group_no").alias("n_groups"), F.sum("series_count").alias("n_series")
    )


@query
def rule_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = inference.assign_batches(_mapped_numbered(spark, sf_dir))
    return rules.rule_prompts(mapped, rules.study_summary(mapped, "scans"))


@query
def study_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.study_summary(_groups(spark, sf_dir), "scans")
