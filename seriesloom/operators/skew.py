"""Equi-joins when a few keys dominate one side, or both.

Adaptive execution splits a partition of one side at a time and only by what single map tasks wrote; a key
that is heavy on both sides stays one product. Here such a key is a grid of cells of bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000
HOT_ROWS = 1_000_000


def _same(keys: list[str], prefix: str) -> Column:
    """Equality of each key with its prefixed twin."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.col(prefix + k) for k in keys])


def hot_keys(
    counts: DataFrame, keys: list[str], n: str, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Keys that hold at least 1/1000 of all rows, with a number of slices for each.

    There can be no more than 1000 of them, whatever the data, so the result may be broadcast.
    ``counts`` has one row per key and is read twice.
    """
    total = counts.agg(F.sum(n)).scalar()
    share = F.ceil(F.col(n) * HOT_SHARE / total)
    return counts.where(
        (F.col(n) * HOT_SHARE >= total) & (F.col(n) >= min_rows)
    ).select(*keys, share.cast("int").alias("slices"))


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    counts: DataFrame,
    n: str,
    row_id: str,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join on ``keys``, hot keys of ``big`` cut into slices.

    A hot key's rows of ``small`` are repeated once per slice and its rows of ``big`` go to the
    slice of their ``row_id``. All other keys have one slice. The result is that of a plain
    join. ``big`` brings the key columns into the result.
    """
    hot = F.broadcast(
        hot_keys(counts, keys, n, min_rows).select(
            *[F.col(k).alias(f"_hot_{k}") for k in keys], F.col("slices").alias("_slices")
        )
    )

    def sliced(df: DataFrame) -> DataFrame:
        mine = df.join(hot, _same(keys, "_hot_"), "left")
        return mine.select(*df.columns, F.coalesce("_slices", F.lit(1)).alias("_slices"))

    left = sliced(big).withColumn(
        "_slice", F.pmod(F.xxhash64(row_id), F.col("_slices").cast("bigint")).cast("int")
    )
    right = sliced(small).select(
        *[F.col(c).alias(f"_small_{c}") for c in small.columns],
        F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_small_slice"),
    )
    condition = _same(keys, "_small_") & (F.col("_slice") == F.col("_small_slice"))
    return left.join(right, condition).select(
        *big.columns, *[F.col(f"_small_{c}").alias(c) for c in small.columns if c not in keys]
    )


def degrees(df: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """Keys with over ``cell`` rows and at least 1/1000 of all, with a number of slices for each.

    No more than 1000 keys, whatever the data.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    heavy = (F.col("_n") > cell) & (F.col("_n") * HOT_SHARE >= df.count())
    return counts.where(heavy).select(*keys, F.ceil(F.col("_n") / cell).cast("int").alias("slices"))


def grid_sides(
    left: DataFrame, right: DataFrame, keys: list[str], cell: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the cell of each row, and the columns to join them on."""
    heavy = {}
    for side, df in (("_l", left), ("_r", right)):
        heavy[side] = degrees(df, keys, cell).withColumnRenamed("slices", side)
    grid = heavy["_l"].join(heavy["_r"], keys, "full").select(
        *[F.col(k).alias(f"_grid_{k}") for k in keys],
        F.coalesce("_l", F.lit(1)).alias("_l"),
        F.coalesce("_r", F.lit(1)).alias("_r"),
    )

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        placed = df.join(F.broadcast(grid), _same(keys, "_grid_"), "left").select(
            *df.columns, *[F.coalesce(c, F.lit(1)).alias(c) for c in ("_l", "_r")]
        )
        slice_of_row = F.pmod(F.xxhash64(*df.columns), F.col(own).cast("bigint")).cast("int")
        return placed.select(
            *df.columns,
            slice_of_row.alias(f"_at{own}"),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"_at{other}"),
        )

    return dealt(left, "_l", "_r"), dealt(right, "_r", "_l"), [*keys, "_at_l", "_at_r"]


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], cell: int = HOT_ROWS) -> DataFrame:
    """Inner join on ``keys``; a heavy key's rows are dealt to a grid of cells.

    A key with ``l`` slices on the left and ``r`` on the right has ``l * r`` cells. A left row goes to its
    slice in each of the ``r`` columns, a right row to its slice in each of the ``l`` rows, so every pair
    meets in one cell, and a cell has about ``cell`` rows of each side. Other keys have one cell.
    The result is that of a plain join. Both sides are read three times: pass staged tables.
    """
    one, other, cells = grid_sides(left, right, keys, cell)
    return one.join(other, cells).drop("_at_l", "_at_r")
