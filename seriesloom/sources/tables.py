"""Reading per-session metadata tables into one typed series table."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions import coerce
from seriesloom.schema import EMPTY_COLUMNS, SERIES_SCHEMA
from seriesloom.sources import splits

SESSION_PATTERN = "dicominfo*.tsv"
AGGREGATED_NAME = "aggregated_dicominfo.tsv"
SINGLE_SESSION = "single_session"

# Other names under which tables carry the subject and session.
_ALIASES = {"subject": "subject_id", "session": "session_id"}
_KNOWN = [f.name for f in SERIES_SCHEMA.fields] + list(_ALIASES.values())
# <subject>[/ses-<session>]/info/<table>
_FROM_PATH = r"([^/]+?)(?:/ses-([^/]+))?/info/[^/]+$"
# A cell, quoted or plain. No part can give back what it has taken, so a match is linear.
_CELL = r'(?:"(?:[^"]++|"")*+"[^\t\n]*+|[^\t\n]*+)'


# --- typing -----------------------------------------------------------------------------------


def _typed(names: list[str], data_type: T.DataType) -> Column:
    """First present value among columns of text, read as ``data_type``."""
    readers = {
        # A missing token is not a number or a flag either, so it needs no test of its own.
        T.DoubleType: coerce.to_number,
        T.LongType: coerce.to_whole,
        T.BooleanType: coerce.to_flag,
    }
    read = readers.get(type(data_type), coerce.blank_to_null)
    values = [read(F.col(n).cast("string")) for n in names]
    return values[0] if len(values) == 1 else F.coalesce(*values)


def to_series(raw: DataFrame) -> DataFrame:
    """All-text table to series columns; missing tokens become null, ids stay text.

    Columns that a series does not have are kept as they are.
    """
    have = set(raw.columns)
    columns = []
    for field in SERIES_SCHEMA.fields:
        names = [n for n in (field.name, _ALIASES.get(field.name)) if n in have]
        if names:
            columns.append(_typed(names, field.dataType).alias(field.name))
    used = {f.name for f in SERIES_SCHEMA.fields} | set(_ALIASES.values())
    kept = [F.col(c) for c in raw.columns if c not in used]
    return raw.select(*columns, *kept)


# --- scans ------------------------------------------------------------------------------------


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """One tab-separated table as ``write_table`` makes it, typed as a series table.

    Quotes inside a value are doubled, and a quoted value may hold tabs and line breaks. A table is
    read in as many tasks as its bytes ask for, however few files it has.
    """
    # Only the header is read here; all files' records are bound to their own file's header.
    names = spark.read.csv(
        path, sep="\t", header=True, inferSchema=False, quote='"', escape='"', multiLine=True
    ).columns
    bound = splits.with_headers(splits.scanned(spark.read, path)).select(
        _cells(F.col("header")).alias("names"), _cells(F.col("line")).alias("cells")
    )
    at = {n: F.array_position("names", F.lit(n)).cast("int") for n in names}
    return to_series(
        bound.select(
            *[
                F.nullif(F.get("cells", F.when(at[n] > 0, at[n] - 1)), F.lit("")).alias(n)
                for n in names
            ]
        )
    )


def _cells(record: Column) -> Column:
    """Cells of a record. The quote-aware form runs only on records that have a quote."""
    quoted = F.transform(
        # Each cell with the tab before it: the record gets one in front.
        F.regexp_extract_all(F.concat(F.lit("\t"), record), F.lit(rf"\t({_CELL})"), F.lit(1)),
        lambda c: F.when(
            c.rlike(r'(?s)^".*"$'),
            F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(c),
    )
    return F.when(record.contains('"'), quoted).otherwise(F.split(record, "\t"))


def _binding(header: Column) -> Column:
    """Where each series column sits in a header, and which other columns there are.

    Computed once per file, so that lines only look up positions.
    """
    names = _cells(header)
    others = F.array_sort(F.array_except(names, F.array(*[F.lit(n) for n in _KNOWN])))
    return F.struct(
        F.array(*[F.array_position(names, n).cast("int") for n in _KNOWN]).alias("at"),
        F.transform(
            others,
            lambda n: F.struct(
                n.alias("name"), F.array_position(names, n).cast("int").alias("at")
            ),
        ).alias("others"),
    )


def session_lines(
    spark: SparkSession,
    root: str,
    pattern: str = SESSION_PATTERN,
    skip_unreadable: bool = True,
) -> DataFrame:
    """``file_path, binding, pos, line`` of every data record under ``root``.

    Headers differ between files, so each record is bound to the header of its own file, the first
    record. Large files are read in blocks.
    """
    reader = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("ignoreCorruptFiles", skip_unreadable)
        .option("ignoreMissingFiles", skip_unreadable)
    )
    return splits.with_headers(splits.scanned(reader, root)).select(
        "file_path", _binding(F.col("header")).alias("binding"), "pos", "line"
    )


def read_session_tables(
    spark: SparkSession,
    root: str,
    pattern: str = SESSION_PATTERN,
    skip_unreadable: bool = True,
) -> DataFrame:
    """Every matching table below ``root``, united by column name and typed.

    Subject and session come from the table, else from the file's own path. Columns that a
    series does not have are kept in ``extra`` as JSON, sorted by name. ``row_ord`` is the place of
    a row in the input: its file, then its position there.
    """
    bound = session_lines(spark, root, pattern, skip_unreadable).withColumn(
        "cells", _cells(F.col("line"))
    )
    at = F.col("binding.at")
    # One column per cell first: typing reads each several times.
    raw = bound.select(
        "file_path",
        F.struct(F.col("file_path").alias("file"), "pos").alias("row_ord"),
        *[F.get("cells", F.get(at, F.lit(i)) - 1).alias(n) for i, n in enumerate(_KNOWN)],
        F.filter(
            F.transform(
                "binding.others",
                lambda o: F.struct(
                    o["name"].alias("name"), F.get("cells", o["at"] - 1).alias("value")
                ),
            ),
            lambda o: coerce.blank_to_null(o["value"]).isNotNull(),
        ).alias("extra"),
    )
    typed = to_series(raw)
    for group, name in enumerate(_ALIASES, start=1):
        from_path = F.nullif(F.regexp_extract("file_path", _FROM_PATH, group), F.lit(""))
        typed = typed.withColumn(name, F.coalesce(name, from_path))
    return typed.select(
        *[f.name for f in SERIES_SCHEMA.fields],
        F.when(F.size("extra") > 0, F.to_json("extra")).alias("extra"),
        "row_ord",
    )


# --- putting tables together --------------------------------------------------------------------


def consolidate(tables: list[DataFrame]) -> DataFrame:
    """Union by column name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def drop_repeats(series: DataFrame) -> DataFrame:
    """Whole-row deduplication, nulls equal. Of equal rows the first by ``row_ord`` stays."""
    if "row_ord" not in series.columns:
        return series.distinct()
    values = [c for c in series.columns if c != "row_ord"]
    return series.groupBy(*values).agg(F.min("row_ord").alias("row_ord")).select(*series.columns)


def with_provenance(series: DataFrame) -> DataFrame:
    """Add ``subject_id`` and ``session_id``; no session becomes ``single_session``."""
    return series.withColumns(
        {
            "subject_id": F.col("subject"),
            "session_id": F.coalesce(
                F.nullif(F.col("session"), F.lit("")), F.lit(SINGLE_SESSION)
            ),
        }
    )


def empty_series(spark: SparkSession) -> DataFrame:
    """The declared columns and no rows."""
    types = {f.name: f for f in SERIES_SCHEMA.fields}
    return spark.createDataFrame([], T.StructType([types[c] for c in EMPTY_COLUMNS]))


def require_rows(table: DataFrame, name: str) -> DataFrame:
    """The table itself, or an error when it has no rows."""
    if table.isEmpty():
        raise ValueError(f"no data in {name}")
    return table


def load_series(spark: SparkSession, output_dir: str, raw_dir: str = ".heudiconv") -> DataFrame:
    """The aggregated table of a directory if there is one, else rebuilt from its sessions."""
    try:
        return require_rows(
            read_table(spark, f"{output_dir}/{AGGREGATED_NAME}"), AGGREGATED_NAME
        )
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
    try:
        sessions = read_session_tables(spark, f"{output_dir}/{raw_dir}")
    except AnalysisException as error:
        raise FileNotFoundError(f"neither {AGGREGATED_NAME} nor {raw_dir} in {output_dir}") from error
    return require_rows(drop_repeats(sessions), f"{output_dir}/{raw_dir}")
