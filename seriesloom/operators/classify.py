"""Keyword classification of every series, checked against a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import keywords, naming
from seriesloom.functions.coerce import numeric_or_zero
from seriesloom.operators import catalog as cat


def classify_series(series: DataFrame, catalog: cat.Catalog) -> DataFrame:
    """Add ``modality, suffix, entities, confidence``.

    One pass without a shuffle. Search text, branch and base class are columns of their own
    because later steps read them several times; as one expression they would multiply.
    """
    text = keywords.search_text(
        F.col("series_description"), F.col("protocol_name"), F.col("sequence_name")
    )
    valid = {d: cat.valid_suffixes(catalog, d) for d in catalog.datatype_names()}
    default = (cat.default_modality(catalog), cat.default_suffix(catalog))
    types = dict(series.dtypes)

    def dim(name: str):
        return numeric_or_zero(F.col(name), types[name])

    branched = series.withColumn("_text", text).withColumn(
        "_branch", keywords.branch_of(F.col("_text"))
    )
    base = keywords.base_class(F.col("_text"), F.col("_branch"), valid, default)
    based = branched.withColumns({f"_{name}": column for name, column in base.items()})
    timed = based.withColumns(
        keywords.as_time_series(
            F.col("_modality"), F.col("_suffix"), F.col("_confidence"), dim("dim4")
        )
    )
    task = F.when(F.col("_branch") == "functional", keywords.task_label(F.col("_text")))
    direction = F.when(F.col("_branch") == "diffusion", keywords.direction_label(F.col("_text")))
    named = timed.withColumns({"_task": task, "_direction": direction})

    def entity(name: str, column: str):
        return F.create_map(F.lit(name), F.col(column))

    # Only one branch holds, so a row has a task or a direction or neither.
    entities = (
        F.when(F.col("_task").isNotNull(), entity("task", "_task"))
        .when(F.col("_direction").isNotNull(), entity("direction", "_direction"))
        .otherwise(F.create_map().cast(naming.EMPTY_MAP))
    )
    return named.select(
        *series.columns,
        "modality",
        "suffix",
        entities.alias("entities"),
        keywords.fine_matrix_penalty(
            F.col("modality"), F.col("confidence"), dim("dim1"), dim("dim2")
        ).alias("confidence"),
    )


def with_path_template(
    classified: DataFrame, catalog: cat.Catalog, include_session: bool = True
) -> DataFrame:
    return classified.withColumn(
        "path_template",
        naming.path_template(
            F.col("modality"),
            F.col("suffix"),
            F.col("entities"),
            list(catalog.entity_order),
            include_session,
        ),
    )
