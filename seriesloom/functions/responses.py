"""Reading structured answers out of model text, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.naming import last_per_key

FENCE = "```"

MAPPING_TYPE = (
    "struct<bids_modality:string,bids_suffix:string,bids_entities:string,"
    "bids_confidence:string,bids_path:string>"
)


def _after_leading_fence(text: Column) -> Column:
    """Drop an opening code-fence line and everything from the last fence on."""
    body = F.when(text.contains("\n"), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(text)
    pieces = F.split(body, FENCE)
    inner = F.when(
        F.size(pieces) > 1, F.array_join(F.slice(pieces, F.lit(1), F.size(pieces) - 1), FENCE)
    ).otherwise(body)
    return F.when(text.startswith(FENCE), strip(inner)).otherwise(text)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def close_of_first_array(pieces: Column) -> Column:
    """How many ']'-separated pieces the array takes that opens the first piece; 0 if unclosed.

    The array closes at the first ']' that balances all '[' so far, so the fold runs over
    brackets and not over characters. Brackets inside string values count too.
    """
    opened = F.transform(
        pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit("["), F.lit("")))
    )
    zero = F.struct(F.lit(0).alias("balance"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def step(state: Column, opens: Column) -> Column:
        seen = state["seen"] + 1
        balance = state["balance"] + opens - 1
        return F.struct(
            balance.cast("int").alias("balance"),
            seen.cast("int").alias("seen"),
            F.when((state["end"] == 0) & (balance == 0) & (seen < F.size(pieces)), seen)
            .otherwise(state["end"])
            .cast("int")
            .alias("end"),
        )

    return F.aggregate(opened, zero, step, lambda s: s["end"])


def without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r",\s*\]", "]"), r",\s*\}", "}")


def _array_elements(text: Column) -> Column:
    """Raw JSON text of each element; null unless the text is a JSON array."""
    return F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))


def with_elements(answered: DataFrame) -> DataFrame:
    """Add ``elements``: the raw JSON elements of each ``response``, null without an array.

    The whole text is tried first. Only if that fails is the text from the first '[' to its
    match cut out, freed of trailing commas and tried again. Steps are columns because each is
    read several times by the next.
    """
    whole = answered.withColumn("_text", strip(F.col("response"))).withColumn(
        "_whole", _array_elements(F.col("_text"))
    )
    is_object = F.col("_text").rlike(r"(?s)^\{.*\}$") & F.from_json(
        "_text", "map<string,string>"
    ).isNotNull()
    retry = F.when(F.col("_whole").isNull() & ~is_object, _after_leading_fence(F.col("_text")))
    start = F.instr("_retry", "[")
    pieces = F.when(
        start > 0, F.split(F.substring(F.col("_retry"), start, F.length("_retry")), r"\]")
    )
    cut = F.when(
        F.col("_close") > 0,
        F.concat(
            F.array_join(F.slice("_pieces", F.lit(1), F.greatest("_close", F.lit(1))), "]"),
            F.lit("]"),
        ),
    )
    tried = (
        whole.withColumn("_retry", retry)
        .withColumn("_pieces", pieces)
        .withColumn("_close", close_of_first_array(F.col("_pieces")))
        .withColumn("_cut", without_trailing_commas(cut))
    )
    return tried.select(
        *answered.columns, F.coalesce("_whole", _array_elements(F.col("_cut"))).alias("elements")
    )


def with_answers(elements: DataFrame) -> DataFrame:
    """Add ``answer``, the mapping struct of each ``element``; null if it is not usable.

    Not usable: no object, or a confidence that is present and not a number.
    """
    parsed = elements.withColumn(
        "_f", F.when(F.col("element").rlike(r"^\s*\{"), F.from_json("element", MAPPING_TYPE))
    )
    confidence = F.col("_f.bids_confidence")
    usable = F.col("_f").isNotNull() & (
        confidence.isNull() | confidence.try_cast("double").isNotNull()
    )
    # An object that repeats a key means its last value, in the path as well as in the map.
    parsed = parsed.withColumn(
        "_entities",
        F.when(
            F.col("_f.bids_entities").rlike(r"^\s*\{"),
            F.from_json("_f.bids_entities", "map<string,string>"),
        ),
    )
    entities = F.when(
        F.col("_entities").isNotNull(),
        last_per_key(F.map_keys("_entities"), F.map_values("_entities")),
    )
    answer = F.struct(
        F.col("_f.bids_modality").alias("bids_modality"),
        F.col("_f.bids_suffix").alias("bids_suffix"),
        entities.alias("bids_entities"),
        confidence.alias("bids_confidence"),
        F.col("_f.bids_path").alias("bids_path"),
    )
    return parsed.select(*elements.columns, F.when(usable, answer).alias("answer"))


def numbered_lines(response: Column) -> Column:
    """Array of (key, pattern) from lines such as '1. anat/sub-x_T1w - why'; bad lines go."""
    lines = F.filter(F.split(strip(response), "\n"), lambda line: line.rlike(r"^\s*\d"))

    def parse(line: Column) -> Column:
        before_dash = F.substring_index(line, " - ", 1)
        pattern = F.when(
            before_dash.contains(". "), F.regexp_replace(before_dash, r"(?s)^.*?\. ", "")
        )
        pieces = F.split(pattern, "/")
        return F.struct(
            F.concat(F.lit("sequence_"), F.substring_index(strip(line), ".", 1)).alias("key"),
            strip(F.when(F.size(pieces) > 1, F.get(pieces, F.lit(1))).otherwise(pattern)).alias(
                "pattern"
            ),
        )

    return F.filter(F.transform(lines, parse), lambda e: e["pattern"].isNotNull())


# Text that a usable rule program must contain.
PROGRAM_MARKS = {
    "has_imports": "from heudiconv.utils import SeqInfo",
    "has_create_key": "def create_key(",
    "has_infotodict": "def infotodict(",
}


def fenced_code(response: Column) -> Column:
    """Body of the first python block, else of the first block, else the text itself."""
    python = F.when(
        response.contains(FENCE + "python"),
        F.regexp_extract(response, r"(?s)```python(.*?)```", 1),
    )
    plain = F.when(
        ~response.contains(FENCE + "python") & response.contains(FENCE),
        F.regexp_extract(response, r"(?s)```(.*?)```", 1),
    )
    closed = F.when(response.contains(FENCE + "python"), response.rlike(r"(?s)```python.*?```"))
    closed = closed.otherwise(response.rlike(r"(?s)```.*?```"))
    return F.when(closed, strip(F.coalesce(python, plain))).otherwise(response)
