"""Which sets are held by some set of a reference table, without a list of all sets per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(sets: DataFrame, holders: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows ``(keys, members, verdict)`` of ``sets``, by the holders of equal keys.

    Both tables have ``keys`` and an array of texts ``members``; order and repeats in it do not matter.
    ``verdict`` is ``held`` if some holder has all members, ``not held`` if none has, ``no holder`` if
    the keys have none at all. An empty or null array is held by any holder. Null keys meet nothing.

    Holders are posted under each of their members. A set asks under its member with the fewest
    holders alone, and a semi join tests the rest, so neither pairs nor lists of holders are built. A
    member without holder settles its set at once.
    """
    no_members = F.array().cast("array<string>")
    listed = F.coalesce(F.array_sort(F.array_distinct("members")), no_members).alias("members")
    wanted = sets.select(*keys, listed).distinct()
    held_by = holders.select(*keys, listed.alias("held")).distinct()
    posted = held_by.select("*", F.explode("held").alias("member"))
    counts = posted.groupBy(*keys, "member").agg(F.count("*").alias("n_holders"))
    known = held_by.select(*keys, F.lit(True).alias("known")).distinct()

    # A set's members come back together with what their counts say about it.
    asked = (
        wanted.select("*", F.explode_outer("members").alias("member"))
        .join(counts, [*keys, "member"], "left")
        .groupBy(*keys, "members")
        .agg(
            F.min_by("member", F.struct("n_holders", "member")).alias("member"),
            F.bool_or(F.col("member").isNotNull() & F.col("n_holders").isNull()).alias("missing"),
        )
        .join(known, keys, "left")
    )
    a, p = asked.alias("a"), posted.alias("p")
    same = F.col("a.member") == F.col("p.member")
    for key in keys:
        same &= F.col(f"a.{key}") == F.col(f"p.{key}")
    complete = F.size(F.array_except("a.members", "p.held")) == 0
    held = (
        a.where(~F.col("missing") & F.col("known"))
        .join(p, same & complete, "left_semi")
        .select(*keys, "members", F.lit(True).alias("held"))
    )
    return asked.join(held, [*keys, "members"], "left").select(
        *keys,
        "members",
        F.when(F.col("known").isNull(), F.lit("no holder"))
        .when((F.size("members") == 0) | F.col("held"), F.lit("held"))
        .otherwise(F.lit("not held"))
        .alias("verdict"),
    )
