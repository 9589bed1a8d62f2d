"""Corpus pipeline: toxicity, language, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), calls one operator and returns the documents it keeps with
all their columns; the last returns the packed pieces. A stage's result is written as Parquet in
the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import langid, nearcopies, packing, suffix, toxicity
from seriesloom.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents with a score of 0.5 or more go. Learns from what comes in."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.learned_lexicon(docs, labels))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents without a letter have no language and go."""
    return langid.keep_known(docs, langid.train(langid.labelled_texts(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near copies the document with the smallest id stays.

    The operator's links are candidates. Near copies are those for which the shingles of five words of the two
    whole texts have a Jaccard similarity of 0.8 or more; those beyond its radius are looked for as well.
    """
    return nearcopies.first_of_each(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: passages that a document with a smaller id holds go; emptied documents go."""
    return suffix.without_passages(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of all documents with their place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_copies", drop_near_copies),
    ("passages", cut_passages),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# The stages learn, link and index beyond what SQL expresses; tests hold them against brute force.
ORACLE_SQL = None
