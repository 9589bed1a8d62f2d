"""Small tables with the awkward cases, and plain versions of what the operators compute."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = {"score": "1", "fp": "2", "block": "3", "has_letter": "4", "row": "5", "_rank": "6"}


def awkward(spark, texts=None):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing columns."""
    words = "the cat of a man and the dog in it is on by to from that house".split()
    long = " ".join(words[(i * 7 + i // 5) % len(words)] + str(i % 97) for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", "s", 3),
        (2, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", "s", 3),
        (2, "the quick brown fox jumps over the lazy dog and runs away from it all", "en", "s", 3),
        (3, None, None, None, None),
        (4, "", "en", None, 0),
        (5, " \t\n\x0b\f\r ", "de", "s", 7),
        (6, long, None, "s", None),
        (7, "12345 67890 !!!", "fr", "s", 1),
        (8, "Größe über Maß: für die Straße, naïve café – 日本語 👩‍👩‍👧", "de", "s", 1),
        (None, "no id at all but some words that are quite plain in this text", "en", "s", 1),
        (9, "a", "en", "s", 1),
    ]
    rows += [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(texts or [])]
    table = spark.createDataFrame(rows, SCHEMA)
    return table.selectExpr("*", *[f"{v} AS {k}" for k, v in EXTRA.items()])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
