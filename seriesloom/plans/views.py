"""Series and path tables derived from the star-schema test data.

Each column is one SQL expression that Spark and DuckDB read alike, so the oracle uses the same
text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES_COLUMNS = {
    "series_id": "e.event_id",
    "row_ord": "e.event_id",
    "subject": "CAST(e.user_id AS VARCHAR(20))",
    "session": "CAST(CAST(e.ts AS DATE) AS VARCHAR(10))",
    "protocol_name": (
        "CASE e.event_type WHEN 'signup' THEN 'T1_MPRAGE' WHEN 'click' THEN 'BOLD_rest' "
        "WHEN 'view' THEN 'T2_space' WHEN 'error' THEN 'DTI_AP' ELSE 'localizer' END"
    ),
    "series_description": (
        "CASE p.p_type WHEN 'PROMO' THEN 'flair scan' WHEN 'LARGE' THEN 'field_b0 phase' "
        "WHEN 'SMALL' THEN 'task faces' ELSE lower(p.p_type) END"
    ),
    "sequence_name": (
        "CASE WHEN p.p_brand IN ('Brand#2','Brand#4') THEN NULL ELSE p.p_brand END"
    ),
    "dim1": (
        "CASE WHEN p.p_size % 7 = 0 THEN 'bad' "
        "ELSE CAST(64 * (1 + p.p_size % 9) AS VARCHAR(8)) END"
    ),
    "dim2": (
        "CASE WHEN p.p_size % 10 = 0 THEN NULL "
        "ELSE CAST(64 * (1 + p.p_size % 9) AS VARCHAR(8)) END"
    ),
    "dim3": "CAST(20 + p.p_size AS VARCHAR(8))",
    "dim4": "CAST(e.event_id % 3 + 1 AS VARCHAR(8))",
    "TR": "CAST(p.p_size % 4 AS DOUBLE) * 500.0",
    "TE": "CAST(p.p_size % 3 AS DOUBLE) * 15.0",
    "is_derived": "CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE e.event_id % 5 = 0 END",
    "is_motion_corrected": "e.event_id % 4 = 0",
    "image_type": (
        "CASE WHEN p.p_partkey % 2 = 0 THEN 'ORIGINAL/PRIMARY/M/NORM' "
        "ELSE 'DERIVED/PRIMARY/M/ND' END"
    ),
    "series_files": "1 + e.event_id % 50",
    "example_dcm_file": "concat('/dcm/', CAST(e.event_id AS VARCHAR(20)), '.dcm')",
    "dcm_dir_name": "concat('d', CAST(e.event_id % 97 AS VARCHAR(20)))",
}

PATH_COLUMNS = {
    "path": (
        "concat(CASE WHEN o.o_orderkey % 13 = 0 THEN 'subject-' ELSE 'sub-' END, "
        "CAST(o.o_custkey AS VARCHAR(20)), "
        "CASE WHEN o.o_orderkey % 3 = 0 THEN '' "
        "ELSE concat('/ses-', CAST(o.o_orderkey % 3 AS VARCHAR(4))) END, "
        "CASE o.o_orderstatus WHEN 'P' THEN '/anat' WHEN 'F' THEN '/func' ELSE '/other' END, "
        "'/sub-', CAST(o.o_custkey AS VARCHAR(20)), "
        "CASE WHEN o.o_orderkey % 5 = 0 THEN '_foo-1' ELSE '_task-rest' END, "
        "CASE o.o_orderstatus WHEN 'P' THEN '_T1w' ELSE '_bold' END, "
        "CASE WHEN o.o_orderkey % 7 = 0 THEN '.txt' ELSE '.nii.gz' END)"
    ),
    "path_id": "o.o_orderkey",
    "length": "o.o_orderkey % 1000",
    "modificationTime": "o.o_orderdate",
}


# Rules of a catalog, one per part; its short entity names are those of the paths below.
RULE_COLUMNS = {
    "rule_id": "p.p_partkey",
    "datatype": "CASE WHEN p.p_size % 2 = 0 THEN 'anat' ELSE 'func' END",
    "suffix": "concat('S', CAST(p.p_partkey % 50 AS VARCHAR(4)))",
    "has_task": "p.p_size % 3 = 0",
    "has_run": "p.p_size % 5 < 2",
    "has_acq": "p.p_size % 7 = 1 AND p.p_size % 2 = 0",
    "in_first": "p.p_partkey % 3 <> 0",
}
# Paths that name the version of the catalog they want.
ASKING_COLUMNS = {
    "path_id": "o.o_orderkey",
    "path": (
        "concat('sub-', CAST(o.o_custkey AS VARCHAR(20)), "
        "CASE WHEN o.o_orderstatus = 'P' THEN '/anat' ELSE '/func' END, "
        "'/sub-', CAST(o.o_custkey AS VARCHAR(20)), "
        "CASE WHEN o.o_orderkey % 3 = 0 THEN '_task-rest' ELSE '' END, "
        "CASE WHEN o.o_orderkey % 4 = 0 THEN '_acq-fast' ELSE '' END, "
        "CASE WHEN o.o_orderkey % 5 = 0 THEN '_run-1' ELSE '' END, "
        "CASE WHEN o.o_orderkey % 11 = 0 THEN '_foo-1' ELSE '' END, "
        "'_S', CAST(o.o_orderkey % 60 AS VARCHAR(4)), '.nii.gz')"
    ),
    "asked": (
        "CASE o.o_custkey % 6 WHEN 0 THEN 'latest' WHEN 1 THEN '1.9.0' WHEN 2 THEN '1.10.0' "
        "WHEN 3 THEN 'nightly' WHEN 4 THEN '2.0.0' ELSE NULL END"
    ),
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in columns.items())


# The same two views as SQL common table expressions, for the oracle.
SERIES_SQL = (
    f"SELECT {_select(SERIES_COLUMNS)} "
    "FROM events e JOIN part p ON p.p_partkey = e.event_id % (SELECT count(*) FROM part)"
)
PATHS_SQL = f"SELECT {_select(PATH_COLUMNS)} FROM orders o"
CATALOG_RULES_SQL = f"SELECT {_select(RULE_COLUMNS)} FROM part p"
ASKING_SQL = f"SELECT {_select(ASKING_COLUMNS)} FROM orders o"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").alias("e")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").alias("p")
    # Every part is used: part keys count up from 0.
    joined = events.join(part, F.expr(f"p.p_partkey = e.event_id % {max(1, part.count())}"))
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in SERIES_COLUMNS.items()])


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").alias("o")
    return orders.selectExpr(*[f"{e} AS {n}" for n, e in PATH_COLUMNS.items()])


def asking_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").alias("o")
    return orders.selectExpr(*[f"{e} AS {n}" for n, e in ASKING_COLUMNS.items()])


def catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents, one per rule and version: all rules are in 1.10.0, two thirds in 1.9.0."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").alias("p")
    rules = part.selectExpr(*[f"{e} AS {n}" for n, e in RULE_COLUMNS.items()])
    versions = F.when(F.col("in_first"), F.array(F.lit("1.9.0"), F.lit("1.10.0"))).otherwise(
        F.array(F.lit("1.10.0"))
    )
    given = F.array_compact(
        F.array(
            F.lit("subject"),
            F.when(F.col("has_task"), F.lit("task")),
            F.when(F.col("has_run"), F.lit("run")),
            F.when(F.col("has_acq"), F.lit("acquisition")),
        )
    )
    needs = F.transform(given, lambda e: F.when(e == "subject", "required").otherwise("optional"))
    short = {"subject": "sub", "task": "task", "run": "run", "acquisition": "acq"}
    entities = F.create_map(
        *[x for e, s in short.items() for x in (F.lit(e), F.struct(F.lit(s).alias("name")))]
    )
    rule = F.struct(
        F.array("suffix").alias("suffixes"), F.map_from_arrays(given, needs).alias("entities")
    )
    raw = F.create_map(
        F.col("datatype"), F.create_map(F.concat(F.lit("rule-"), F.col("rule_id")), rule)
    )
    return rules.withColumn("version", F.explode(versions)).select(
        F.to_json(
            F.struct(
                F.col("version").alias("schema_version"),
                F.struct(entities.alias("entities")).alias("objects"),
                F.struct(F.struct(raw.alias("raw")).alias("files")).alias("rules"),
            )
        ).alias("value")
    )


# --- model answers built from known columns -----------------------------------------------------

# Five kinds of answer, by position: complete; path to be rebuilt; unknown datatype; entities
# that are no object; datatype only.
def mapping_answers(batched: DataFrame) -> DataFrame:
    """One JSON array per batch, damaged in one of seven ways by ``batch_id``.

    0 none, 1 code fence, 2 text around, 3 trailing commas, 4 last ']' missing, 5 one record
    short, 6 confidence as a word at odd positions.
    """
    kind = F.col("pos") % 5
    score = F.when(
        (F.col("batch_id") % 7 == 6) & (F.col("pos") % 2 == 1), F.lit('"high"')
    )
    tail = F.when(F.col("batch_id") % 7 == 3, F.lit(",}")).otherwise(F.lit("}"))

    def entry(modality: str, suffix: str, entities: Column, confidence: str, path: Column):
        return F.concat(
            F.lit(
                f'{{"bids_modality": "{modality}", "bids_suffix": "{suffix}", "bids_entities": '
            ),
            entities,
            F.lit(', "bids_confidence": '),
            F.coalesce(score, F.lit(confidence)),
            F.lit(', "bids_path": "'),
            path,
            F.lit('"'),
            tail,
        )

    acquisition = F.concat(F.lit('{"acq": "'), F.col("protocol_name"), F.lit('"}'))
    element = (
        F.when(
            kind == 0,
            entry(
                "anat",
                "T1w",
                acquisition,
                "0.95",
                F.concat(
                    F.lit("anat/sub-{subject}_ses-{session}_acq-"),
                    F.col("protocol_name"),
                    F.lit("_T1w"),
                ),
            ),
        )
        .when(
            kind == 1,
            entry("func", "bold", F.lit('{"task": "rest", "run": 1}'), "0.8", F.lit("unmapped")),
        )
        .when(kind == 2, entry("eeg", "eeg", F.lit("{}"), "0.9", F.lit("eeg/x")))
        .when(kind == 3, entry("dwi", "dwi", F.lit('"none"'), "0.7", F.lit("")))
        .otherwise(
            F.concat(
                F.lit('{"bids_modality": "perf"'),
                F.coalesce(F.concat(F.lit(', "bids_confidence": '), score), F.lit("")),
                tail,
            )
        )
    )
    listed = batched.groupBy("study", "batch_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", element.alias("element")))).alias("rows")
    )
    damage = F.col("batch_id") % 7
    shown = F.transform(
        F.when(damage == 5, F.slice("rows", F.lit(1), F.size("rows") - 1)).otherwise(F.col("rows")),
        lambda r: r["element"],
    )
    body = F.concat(
        F.lit("["),
        F.array_join(shown, ", "),
        F.when(damage == 3, F.lit(",")).otherwise(F.lit("")),
        F.when(damage == 4, F.lit("")).otherwise(F.lit("]")),
    )
    return listed.select(
        "study",
        "batch_id",
        F.lit(0).alias("first_pos"),
        F.size("rows").alias("n_groups"),
        F.when(damage == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(damage == 2, F.concat(F.lit("The mapping:\n"), body, F.lit("\nThat is all.")))
        .otherwise(body)
        .alias("response"),
    )


def numbered_answers(batched: DataFrame) -> DataFrame:
    """Numbered lines per batch; every fourth is malformed and number 1 comes twice."""
    number = (F.col("pos") + 1).cast("string")
    line = (
        F.when(F.col("pos") % 4 == 3, F.concat(number, F.lit(" is unclear")))
        .when(
            F.col("pos") % 2 == 0,
            F.concat(number, F.lit(". anat/sub-{subject}_"), "protocol_name", F.lit(" - why")),
        )
        .otherwise(F.concat(F.lit("  "), number, F.lit(". "), "series_description"))
    )
    listed = batched.groupBy("study", "batch_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows")
    )
    return listed.select(
        "study",
        "batch_id",
        F.concat(
            F.lit("Suggested names:\n"),
            F.array_join(F.transform("rows", lambda r: r["line"]), "\n"),
            F.lit("\n1. func/again_"),
            F.col("batch_id").cast("string"),
            F.lit(" - second thought\n"),
        ).alias("response"),
    )


def program_answers(batched: DataFrame) -> DataFrame:
    """Program text per batch: python fence, plain fence, no fence, or a part missing."""
    keys = batched.groupBy("study", "batch_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("group_id").alias("id")))).alias("rows")
    )
    body = F.concat(
        F.lit("from heudiconv.utils import SeqInfo\n"),
        F.when(F.col("batch_id") % 4 == 3, F.lit("")).otherwise(F.lit("def create_key(t):\n    return t\n")),
        F.lit("def infotodict(seqinfo):\n    # "),
        F.array_join(F.transform("rows", lambda r: r["id"]), " "),
        F.lit("\n    return {}"),
    )
    kind = F.col("batch_id") % 4
    return keys.select(
        "study",
        "batch_id",
        F.when(kind == 0, F.concat(F.lit("Sure:\n```python\n"), body, F.lit("\n```\nDone.")))
        .when(kind == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .otherwise(body)
        .alias("response"),
    )
