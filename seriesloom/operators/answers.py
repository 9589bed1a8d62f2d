"""A store of model answers: each distinct prompt is asked until it is answered, and then no more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators.inference import Responder

STORE_SCHEMA = "prompt_key string, attempt int, answer string, error string"


def with_key(prompts: DataFrame) -> DataFrame:
    """Add ``prompt_key``, a hash of the text ``prompt``; a null prompt has none."""
    return prompts.withColumn("prompt_key", F.sha2("prompt", 256))


def _attempts(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(STORE_SCHEMA).parquet(store)


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """``(prompt_key, attempts, answer, error)``: the first answer of a prompt, else its last error."""
    answered = F.col("answer").isNotNull()
    return (
        _attempts(spark, store)
        .groupBy("prompt_key")
        .agg(
            F.max("attempt").alias("attempts"),
            F.min_by("answer", F.when(answered, F.col("attempt"))).alias("answer"),
            F.max_by("error", "attempt").alias("last_error"),
        )
        .select(
            "prompt_key",
            "attempts",
            "answer",
            F.when(F.col("answer").isNull(), F.col("last_error")).alias("error"),
        )
    )


def ask_missing(
    prompts: DataFrame,
    store: str,
    make_responder: Callable[[], Responder],
    tasks: int,
    batch_size: int = 16,
    max_attempts: int = 2,
) -> None:
    """Ask what ``store`` has no answer for and append the outcomes, one row per prompt asked.

    Equal prompts, of whatever study, are asked once. A prompt that failed ``max_attempts`` times is left
    alone; its last error stays. A batch that fails or comes back short is halved down to single
    prompts, so that only those which fail by themselves have no answer. ``make_responder`` runs once
    per task. An interrupted call leaves no rows, as files appear when the whole write is done; one
    call at a time may write to a store.
    """
    spark = prompts.sparkSession
    spark.createDataFrame([], STORE_SCHEMA).write.mode("ignore").parquet(store)
    known = stored_answers(spark, store).select("prompt_key", "attempts", "answer")
    settled = F.col("answer").isNotNull() | (F.col("attempts") >= max_attempts)
    distinct = with_key(prompts.select("prompt")).dropDuplicates(["prompt_key"])
    asked = (
        distinct.where(F.col("prompt").isNotNull())
        .join(known.where(settled), "prompt_key", "left_anti")
        .join(known.select("prompt_key", "attempts"), "prompt_key", "left")
        .select("prompt_key", "prompt", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempt"))
        .repartition(tasks, "prompt_key")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        responder = None

        def outcomes(texts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                answers, error = list(responder(texts) or []), "no answer"
            except Exception as failure:  # noqa: BLE001
                answers, error = [], f"{type(failure).__name__}: {failure}"
            if len(answers) >= len(texts):
                answers = answers[: len(texts)]
                return [(a, "no answer" if a is None else None) for a in answers]
            if len(texts) == 1:
                return [(None, error)]
            half = len(texts) // 2
            return outcomes(texts[:half]) + outcomes(texts[half:])

        for frame in frames:
            if responder is None and len(frame):
                responder = make_responder()
            texts, found = frame["prompt"].tolist(), []
            for start in range(0, len(texts), batch_size):
                found += outcomes(texts[start : start + batch_size])
            yield pd.DataFrame(
                {
                    "prompt_key": frame["prompt_key"],
                    "attempt": frame["attempt"],
                    "answer": [answer for answer, _ in found],
                    "error": [error for _, error in found],
                }
            )

    asked.mapInPandas(run, STORE_SCHEMA).write.mode("append").parquet(store)


def with_answers(prompts: DataFrame, store: str) -> DataFrame:
    """Add ``attempts, answer, error``; null where a prompt was never asked."""
    keyed = with_key(prompts)
    found = stored_answers(prompts.sparkSession, store)
    return keyed.join(found, "prompt_key", "left").drop("prompt_key")
