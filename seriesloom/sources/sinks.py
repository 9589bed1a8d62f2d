"""Writing results: Parquet between steps, tab-separated text for people and other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(df: DataFrame) -> DataFrame:
    nested = {
        f.name: F.to_json(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))
    }
    return df.withColumns(nested) if nested else df


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated text with a header, maps and lists as JSON."""
    (
        _flat(df)
        .write.mode(mode)
        .option("sep", "\t")
        .option("header", True)
        .option("emptyValue", "")
        # Quotes inside a value are doubled, as tab-separated readers expect.
        .option("escape", '"')
        .csv(path)
    )


def with_first_names(groups: DataFrame) -> DataFrame:
    """Add the ``*_first`` spellings that readers of the group table may look up."""
    names = ["example_dcm_file", "dcm_dir_name", "subject", "session"]
    return groups.withColumns({f"{n}_first": F.col(n) for n in names if n in groups.columns})


def write_programs(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One directory per study; its part files in name order are the program."""
    order = ["study", "section", "group_no", "variant_no", "line_no"]
    (
        lines.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("study", F.col("line").alias("value"))
        .write.mode(mode)
        .partitionBy("study")
        .text(path)
    )


def store_results(results: DataFrame, path: str, source: str) -> None:
    """Append results under their fingerprint, with time and source.

    Sorted by fingerprint rather than one folder for each, so a lookup prunes row groups and
    the table keeps a moderate number of files.
    """
    (
        results.withColumns(
            {"extraction_time": F.current_timestamp(), "source_directory": F.lit(source)}
        )
        .repartitionByRange("fingerprint")
        .sortWithinPartitions("fingerprint")
        .write.mode("append")
        .parquet(path)
    )
