"""Operator 2: quality rules as one projection of built-in expressions.

A table of thresholds (measure, lowest, highest value) is compiled into one Boolean expression
over measures of a document: length, symbols, stop words, lines and repeated word windows.
Nothing runs outside the JVM and nothing is shuffled; each measure is linear, or ``n log n`` in the
number of words where windows are sorted, for texts of any length.

Ratios are compared as whole numbers (``100 * part`` against ``percent * whole``), so the verdict
does not depend on rounding.

Defined results: a null text and a text of white space hold no word; they fail the base rule.
Repeated rows each get their row. Other columns, whatever their names, are not read; the
result has only the columns named here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it that for was on are as with by be this have from or at "
    "der die das und ist von mit den zu nicht sich auf für im ein eine als auch dem des "
    "le la les et des un une du que est pour dans qui sur pas par plus avec ce il "
    "el los las y del por con para una como más lo su al es en de se"
).split()


@dataclass(frozen=True)
class Limit:
    """``low <= value <= high``, or in percent of ``whole`` where that is named."""

    value: str
    low: int | None = None
    high: int | None = None
    whole: str | None = None

    def holds(self) -> Column:
        value, unit = F.col(self.value), F.lit(1)
        if self.whole:
            value, unit = value * 100, F.col(self.whole)
        result = F.lit(True)
        if self.low is not None:
            result = result & (value >= unit * self.low)
        if self.high is not None:
            result = result & (value <= unit * self.high)
        return result


# The rules besides the base rule, which the caller's contract fixes.
LIMITS = (
    Limit("word_chars", low=200, high=1500, whole="n_words"),
    Limit("n_symbols", high=10, whole="n_words"),
    Limit("n_stop_words", low=2, whole="n_words"),
    Limit("n_dup_lines", high=30, whole="n_lines"),
    Limit("n_upper_words", high=50, whole="n_words"),
)


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures of each document as columns beside its key."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    base = docs.select(
        F.col(key),
        F.length(whole).alias("_chars"),
        F.length(F.translate(whole, SPACES, "")).alias("word_chars"),
        F.length(F.translate(whole, SYMBOLS, "")).alias("_plain"),
        words.alias("_words"),
        lines.alias("_lines"),
    )
    hashed = base.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_hash")
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get(F.col("_hash"), i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    windowed = hashed.withColumn("_windows", windows)
    # Only a text with a repeated window pays for sorting: (hash, place) in order, then the places
    # whose hash has an equal neighbour.
    ranked = windowed.withColumn(
        "_ranked",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    places = F.array_sort(
        F.transform(
            F.filter(
                F.col("_ranked"),
                lambda e, i: (e["h"] == F.get(F.col("_ranked"), i - 1)["h"])
                | (e["h"] == F.get(F.col("_ranked"), i + 1)["h"]),
            ),
            lambda e: e["i"],
        )
    )
    placed = ranked.withColumn("_places", places)
    # A place covers WINDOW words, or as many as lie before the next place.
    covered = F.aggregate(
        F.transform(
            "_places",
            lambda p, i: F.least(
                F.coalesce(F.get(F.col("_places"), i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)
            ),
        ),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    stop = F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS)))
    upper = F.size(F.filter("_words", lambda w: w.rlike("\\p{Lu}{2}") & ~w.rlike("\\p{Ll}")))
    return placed.select(
        F.col(key),
        F.size("_words").cast("bigint").alias("n_words"),
        F.col("word_chars").cast("bigint").alias("word_chars"),
        (F.col("_chars") - F.col("_plain")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        stop.cast("bigint").alias("n_stop_words"),
        upper.cast("bigint").alias("n_upper_words"),
    )


def base_failed() -> Column:
    """Fewer than 10 words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def verdicts(docs: DataFrame, limits: tuple[Limit, ...] = LIMITS) -> DataFrame:
    """Measures, base verdict and the verdict of all limits for every whole text."""
    passed = F.lit(True)
    for limit in limits:
        passed = passed & limit.holds()
    judged = measures(docs).withColumn("base_failed", base_failed())
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & passed).alias("kept"),
        "n_lines",
        "n_stop_words",
        "n_upper_words",
    )
