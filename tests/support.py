"""Session and comparison helpers for the tests."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession

from seriesloom.functions import keywords
from seriesloom.operators.inference import CONTRACT, RECORDS_MARK


def local_session(cores: str | None = None) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seriesloom")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="seriesloom-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _as_text(value) -> str:
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return "<null>"
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value)


def same_values(actual: pd.DataFrame, expected: pd.DataFrame) -> str:
    """Empty when both hold the same rows in any order, else what differs."""
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} vs {sorted(expected.columns)}"
    columns = sorted(actual.columns)
    left = sorted(tuple(map(_as_text, row)) for row in actual[columns].itertuples(index=False))
    right = sorted(tuple(map(_as_text, row)) for row in expected[columns].itertuples(index=False))
    if left == right:
        return ""
    only_left = [row for row in left if row not in set(right)][:2]
    only_right = [row for row in right if row not in set(left)][:2]
    return (
        f"{len(left)} vs {len(right)} rows; {columns}\n  only ours: {only_left}"
        f"\n  only oracle: {only_right}"
    )


def keyword_model() -> Callable[[], Callable[[list[str]], list[str]]]:
    """Loader of a stand-in for a model, for tests alone: answers by the last-resort rules.

    What it needs travels with it, so workers do not have to have this package installed.
    """
    rules, unknown, unmapped = keywords.LAST_RESORT, keywords.UNKNOWN, keywords.UNMAPPED
    mark, contract = RECORDS_MARK, CONTRACT

    def answer(prompt: str) -> str:
        # The last mark opens the records; notes may contain the same words.
        body = prompt.rsplit(mark, 1)[1].rsplit(contract, 1)[0]
        mappings = []
        for record in json.loads(body):
            text = (record["protocol_name"] + record["series_description"]).lower()
            mapping = {
                "bids_modality": unknown,
                "bids_suffix": unknown,
                "bids_entities": {},
                "bids_confidence": 0.6,
                "bids_path": unmapped,
            }
            for words, datatype, suffix, task, path in rules:
                if any(word in text for word in words):
                    mapping.update(bids_modality=datatype, bids_suffix=suffix, bids_path=path)
                    mapping["bids_entities"] = {"task": task} if task else {}
                    break
            mappings.append(mapping)
        return json.dumps(mappings)

    return lambda: lambda prompts: [answer(p) for p in prompts]
