"""Working out subjects, sessions and changes from a file listing alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.staging import stage


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, length, modificationTime`` below ``root``; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length", "modificationTime")
    )


def relative_paths(listing: DataFrame, root: str) -> DataFrame:
    """Paths below ``root`` without it. Listings show a scheme such as ``file:`` before it."""
    marker = root.rstrip("/") + "/"
    start = F.instr(F.col("path"), F.lit(marker))
    below = F.when(
        start > 0, F.substring(F.col("path"), start + len(marker), F.length("path"))
    ).otherwise(F.col("path"))
    return listing.withColumn("path", below)


def discover_sessions(listing: DataFrame) -> DataFrame:
    """``subject, session`` pairs of a tree, from paths relative to its root.

    Layouts in order: ``sub-*`` entries (sessions ``ses-*``, prefixes cut off); directories that
    start with a digit (sessions start with a digit or ``ses``, names whole); else the whole tree
    is subject ``01``. One layout holds for the whole tree. A subject without sessions has one
    null session.
    """
    below = F.when(
        F.col("path").contains("/"),
        F.substring(F.col("path"), F.length("first") + 2, F.length("path")),
    )
    split = (
        listing.select("path", F.substring_index("path", "/", 1).alias("first"))
        .withColumn("below", below)
        .withColumn("second", F.substring_index("below", "/", 1))
    )
    first, second = F.col("first"), F.col("second")
    prefixed = first.startswith("sub-")
    numbered = first.rlike(r"^\d") & F.col("below").isNotNull()
    is_directory = F.col("below").contains("/")
    found = split.select(
        F.when(prefixed, 1).when(numbered, 2).alias("layout"),
        F.when(prefixed, F.substring(first, F.lit(5), F.length(first)))
        .otherwise(first)
        .alias("subject"),
        F.when(
            prefixed & second.startswith("ses-"), F.substring(second, F.lit(5), F.length(second))
        )
        .when(~prefixed & is_directory & second.rlike(r"^(\d|ses)"), second)
        .alias("session"),
    ).distinct()
    # The listing is read once; everything below works on its distinct pairs.
    found = stage(found, "pairs").where(F.col("layout").isNotNull())
    best = found.agg(F.min("layout").alias("layout")).scalar()
    chosen = found.where(F.col("layout") == best)
    subjects = chosen.select("layout", "subject").distinct()
    pairs = chosen.where(F.col("session").isNotNull()).join(
        subjects.select("subject"), "subject", "left_semi"
    )
    alone = subjects.join(pairs.select("subject"), "subject", "left_anti")
    whole_tree = (
        listing.sparkSession.range(1)
        .where(best.isNull())
        .select(F.lit("01").alias("subject"), F.lit(None).cast("string").alias("session"))
    )
    return (
        pairs.select("subject", "session")
        .unionByName(alone.select("subject", F.lit(None).cast("string").alias("session")))
        .unionByName(whole_tree)
    )


# --- change detection ---------------------------------------------------------------------------


def _directory() -> Column:
    return F.regexp_replace("path", "/?[^/]*$", "")


def _stamp() -> Column:
    """name:length:mtime of a file."""
    return F.concat_ws(
        ":",
        F.substring_index("path", "/", -1),
        F.col("length").cast("string"),
        F.unix_millis(F.col("modificationTime").cast("timestamp")).cast("string"),
    )


def fingerprints(listing: DataFrame, directory: Column | None = None) -> DataFrame:
    """``directory, n_files, fingerprint`` over *all* files of each directory.

    A directory may hold most files, so its files are never listed together. Each file's md5
    gives two numbers, and the sums of both over the directory, which do not depend on order
    and combine on the map side, are what is hashed.
    """
    digest = F.md5(_stamp())

    def lane(start: int) -> Column:
        number = F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")
        return F.sum(number).cast("string")

    summed = listing.groupBy((_directory() if directory is None else directory).alias("directory")).agg(
        F.count("*").alias("n_files"),
        F.sum("length").alias("n_bytes"),
        lane(1).alias("low"),
        lane(16).alias("high"),
    )
    return summed.select(
        "directory",
        "n_files",
        F.md5(
            F.concat_ws(
                ":",
                "directory",
                F.col("n_files").cast("string"),
                F.col("n_bytes").cast("string"),
                "low",
                "high",
            )
        ).alias("fingerprint"),
    )


def split_by_change(current: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Directories whose stored result can be reused, and those to compute again."""
    keys = ["directory", "fingerprint"]
    seen = stored.select(*keys)
    return current.join(seen, keys, "left_semi"), current.join(seen, keys, "left_anti")


def change_report(current: DataFrame, stored: DataFrame) -> DataFrame:
    keys = ["directory", "fingerprint"]
    seen = stored.select(*keys, F.lit(True).alias("seen")).distinct()
    return current.join(seen, keys, "left").select(
        *current.columns,
        F.when(F.col("seen"), F.lit("reuse")).otherwise(F.lit("recompute")).alias("status"),
    )
