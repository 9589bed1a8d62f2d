"""Value clean-up for raw metadata: missing-value tokens, numbers, booleans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that a metadata table uses for "no value".
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Spark also reads '1d' and '1f' as numbers; metadata must not.
_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))$"


def blank_to_null(column: Column) -> Column:
    return F.when(~column.isin(NA_TOKENS), column)


def to_number(column: Column) -> Column:
    """Number in a text or numeric column, null when it is not one."""
    text = F.trim(column.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def number_or_zero(column: Column) -> Column:
    return F.coalesce(to_number(column), F.lit(0.0))


def numeric_or_zero(column: Column, data_type: str) -> Column:
    """``number_or_zero`` that skips the text checks where the column already is a number."""
    if data_type in ("double", "float"):
        return F.coalesce(F.nanvl(column.cast("double"), F.lit(None)), F.lit(0.0))
    if data_type in ("bigint", "int", "smallint", "tinyint", "boolean") or data_type.startswith(
        "decimal"
    ):
        return F.coalesce(column.cast("double"), F.lit(0.0))
    return number_or_zero(column)


def to_whole(column: Column) -> Column:
    return to_number(column).try_cast("bigint")


def to_flag(column: Column) -> Column:
    text = F.lower(F.trim(column.cast("string")))
    return F.when(text == "true", True).when(text == "false", False)
