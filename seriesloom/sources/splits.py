"""Records of quoted tab-separated files, read in byte ranges.

A quoted cell may hold line breaks, so whether a line starts a record depends on all lines before it.
What a line does to that state ("inside a quoted cell or not") is a function of two values, known
from the line alone: it keeps the state, turns it round, or sets it. Functions compose, so

1. a file's lines are read in blocks by Spark's own splits, whatever the size of the file, and written
   once, which fixes the blocks (another scan may split anew when executors have come or gone);
2. files in which no line opens a cell for the next one are done: a line is a record, and its number
   follows from the lines of the blocks before;
3. inside a block of the other files, a running composition gives the state of each line for both
   states at its start;
4. one row per block is composed along the file, which gives the true start state of each block
   and the number of records before it;
5. lines take their block's state; those of records over several lines are put together by file
   and record number, also over blocks.

Only a block's lines and one row per block of a file are ever sorted together. A quote that is never
closed is an ordinary character: the lines after it are records of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, Window
from pyspark.sql import functions as F

from seriesloom.staging import stage

# Blocks (or files) up to which a table with one row for each is broadcast: some 40 MB.
FEW = 200_000

# Parts of a line. No part gives back what it has taken, so matching is linear.
_INSIDE = r'(?:[^"]++|"")*+'
_CLOSED = rf'(?:"{_INSIDE}"[^\t]*+|(?!")[^\t]*+)'
_OPEN_END = rf'(?:{_CLOSED}\t)*+"{_INSIDE}\z'
# The line ends inside a quoted cell if it started outside, or inside, of one.
_FROM_OUTSIDE = rf"\A{_OPEN_END}"
_FROM_INSIDE = rf'\A{_INSIDE}(?:\z|"[^\t]*+\t{_OPEN_END})'
_ALL_INSIDE = rf"\A{_INSIDE}\z"


def _as_int(condition: Column) -> Column:
    return condition.cast("int")


def _composed(df: DataFrame, outside: str, inside: str, window) -> DataFrame:
    """Adds ``after0`` and ``after1``: the state after a row, by the state before the first row.

    ``outside`` and ``inside`` are the states after the row alone. Since the last row that sets the
    state, only turns count, and a running sum has their number.
    """
    turned = F.sum(_as_int((F.col(outside) == 1) & (F.col(inside) == 0))).over(window) % 2
    set_to = F.when(F.col(outside) == F.col(inside), F.col(outside).bitwiseXOR(F.col("_turned")))
    return (
        df.withColumn("_turned", turned.cast("int"))
        .withColumn("_set", F.last(set_to, ignorenulls=True).over(window))
        .withColumn("after0", F.coalesce("_set", F.lit(0)).bitwiseXOR(F.col("_turned")))
        .withColumn("after1", F.coalesce("_set", F.lit(1)).bitwiseXOR(F.col("_turned")))
        .drop("_turned", "_set")
    )


def text_lines(reader: DataFrameReader, root: str) -> DataFrame:
    """Every line with its ``file_path, block, ord``, and what it does to the state.

    A block is one of Spark's splits of a file.
    """
    value = F.col("value")
    quoted = value.contains('"')
    return reader.option("lineSep", "\n").text(root).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        # Ascends by one inside a split in the order of its lines.
        F.monotonically_increasing_id().alias("ord"),
        "value",
        _as_int(~value.isin("", "\r")).alias("filled"),
        _as_int(quoted & value.rlike(_FROM_OUTSIDE)).alias("outside"),
        _as_int(~quoted | value.rlike(_FROM_INSIDE)).alias("inside"),
        (~quoted | value.rlike(_ALL_INSIDE)).alias("passes"),
    )


def scanned(reader: DataFrameReader, root: str) -> DataFrame:
    """``text_lines`` as a written table."""
    return stage(text_lines(reader, root), "lines")


def _traced(lines: DataFrame) -> DataFrame:
    """Lines with state before and after, and running numbers of starts, for both start states."""
    along = Window.partitionBy("file_path", "block").orderBy("ord")
    traced = _composed(lines, "outside", "inside", along)
    traced = traced.withColumn("place", F.sum("filled").over(along))
    for start in (0, 1):
        before = F.lag(f"after{start}", 1, start).over(along)
        traced = traced.withColumn(f"before{start}", before)
        traced = traced.withColumn(
            f"starts{start}", _as_int((F.col("filled") == 1) & (F.col(f"before{start}") == 0))
        )
        traced = traced.withColumn(f"number{start}", F.sum(f"starts{start}").over(along))
        opens = (F.col(f"after{start}") == 1) & ~((F.col(f"before{start}") == 1) & F.col("passes"))
        traced = traced.withColumn(f"opens{start}", opens)
    return traced.drop("outside", "inside", "passes")


def _blocks(traced: DataFrame) -> DataFrame:
    """One row per block: its start state, records before it, and where loose lines begin.

    If a file ends inside a quoted cell, the last line that opens one has the quote that is never closed.
    Of the filled lines of a block, those from ``loose_from`` on come after it; the first of them
    gets the record number ``loose_at``.
    """
    per_block = traced.groupBy("file_path", "block").agg(
        F.max_by("after0", "ord").alias("end0"),
        F.max_by("after1", "ord").alias("end1"),
        F.max("place").alias("filled"),
        *[F.max(f"number{s}").alias(f"n{s}") for s in (0, 1)],
        *[F.max(F.when(F.col(f"opens{s}"), F.col("place"))).alias(f"opened{s}") for s in (0, 1)],
    )
    along = Window.partitionBy("file_path").orderBy("block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file_path")
    states = _composed(per_block, "end0", "end1", along).withColumn(
        "state", F.lag("after0", 1, 0).over(along)
    )
    chosen = lambda name: F.when(F.col("state") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    numbered = (
        states.withColumns({"n": chosen("n"), "opened": chosen("opened")})
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("open", F.max_by("after0", "block").over(whole))
        .withColumn("tail", F.max(F.when(F.col("opened").isNotNull(), F.col("block"))).over(whole))
    )
    loose = F.when(F.col("block") == F.col("tail"), F.col("opened") + 1).when(
        F.col("block") > F.col("tail"), F.lit(1)
    )
    first = F.max(F.when(F.col("block") == F.col("tail"), F.col("before") + F.col("n"))).over(whole)
    return (
        numbered.withColumn("loose_from", F.when(F.col("open") == 1, loose))
        .withColumn("_loose", F.col("filled") - F.col("loose_from") + 1)
        .withColumn("loose_at", first + F.coalesce(F.sum("_loose").over(earlier), F.lit(0)))
        .select("file_path", "block", "state", "before", "loose_from", "loose_at")
    )


def _pieced(lines: DataFrame) -> DataFrame:
    """Records of files where a line may go on with the record of the one before."""
    traced = _traced(lines)
    placed = traced.join(_blocks(traced.drop("value")), ["file_path", "block"])
    chosen = lambda name: F.when(F.col("state") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    placed = placed.withColumns(
        {
            "loose": (F.col("filled") == 1)
            & F.coalesce(F.col("place") >= F.col("loose_from"), F.lit(False)),
            "lost": (F.col("filled") == 0)
            & F.coalesce(F.col("place") >= F.col("loose_from") - 1, F.lit(False)),
            "starts": chosen("starts") == 1,
            "goes_on": chosen("before") == 1,
            # The line ends its record: outside of quotes, or with the quote that is never closed.
            "whole": (chosen("starts") == 1)
            & ((chosen("after") == 0) | F.coalesce(F.col("place") == F.col("loose_from") - 1, F.lit(False))),
        }
    )
    kept = placed.where(~F.col("lost") & (F.col("loose") | F.col("starts") | F.col("goes_on"))).select(
        "file_path",
        F.when(F.col("loose"), F.col("loose_at") + F.col("place") - F.col("loose_from"))
        .otherwise(F.col("before") + chosen("number") - 1)
        .alias("pos"),
        (F.col("loose") | F.col("whole")).alias("alone"),
        "block",
        "ord",
        "value",
    )
    joined = (
        kept.where(~F.col("alone"))
        .groupBy("file_path", "pos")
        .agg(F.array_sort(F.collect_list(F.struct("block", "ord", "value"))).alias("parts"))
        .select("file_path", "pos", F.array_join(F.col("parts.value"), "\n").alias("line"))
    )
    single = kept.where("alone").select("file_path", "pos", F.col("value").alias("line"))
    return single.unionByName(joined).withColumn("line", F.regexp_replace("line", r"\r\z", ""))


def _few(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= FEW else table


def _sorted_out(lines: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """One row per block; plain lines with their record's number; lines of the other files."""
    per_block = lines.groupBy("file_path", "block").agg(
        F.min("ord").alias("first"),
        F.count("*").alias("n"),
        F.max(F.greatest("outside", 1 - F.col("filled"))).alias("special"),
    )
    along = Window.partitionBy("file_path").orderBy("block")
    blocks = stage(
        per_block.select(
            "file_path",
            "block",
            "first",
            F.coalesce(
                F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("before"),
            (F.max("special").over(Window.partitionBy("file_path")) == 0).alias("plain"),
        ),
        "line-blocks",
    )
    n, n_plain = blocks.agg(F.count("*"), F.count_if("plain")).first()
    plain, others = None, None
    if n_plain:
        mine = _few(blocks.where("plain").drop("plain"), n)
        number = (F.col("before") + F.col("ord") - F.col("first")).alias("pos")
        plain = lines.join(mine, ["file_path", "block"]).select("file_path", "block", number, "value")
    if n_plain < n or not n:
        mine = _few(blocks.where("NOT plain").select("file_path", "block"), n)
        others = lines.join(mine, ["file_path", "block"], "left_semi")
    return blocks, plain, others


def _united(plain: DataFrame | None, pieced: DataFrame | None) -> DataFrame:
    line = F.regexp_replace("value", r"\r\z", "").alias("line")
    parts = [] if plain is None else [plain.select("file_path", "pos", line)]
    parts += [] if pieced is None else [pieced]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def records(lines: DataFrame) -> DataFrame:
    """``file_path, pos, line``: every record of the files and its number there, from 0.

    Line breaks inside a quoted cell stay in the record, a carriage return before the last one does
    not, and empty lines outside of quotes are no records. ``lines`` is a ``scanned`` table.
    """
    _, plain, others = _sorted_out(lines)
    return _united(plain, None if others is None else _pieced(others))


def with_headers(lines: DataFrame) -> DataFrame:
    """``file_path, header, pos, line``: records after the first, each with the first of its file.

    The header is looked for in a file's first block alone; a file with records whose header does not
    end there is an error. ``lines`` is a ``scanned`` table.
    """
    blocks, plain, others = _sorted_out(lines)
    every = _united(plain, None if others is None else _pieced(others))
    n_files = blocks.where("block = 0").count()
    firsts = _united(
        None if plain is None else plain.where("block = 0"),
        None if others is None else _pieced(others.where("block = 0")),
    )
    firsts = firsts.where("pos = 0").select("file_path", F.col("line").alias("header"))
    bound = every.join(_few(firsts, n_files), "file_path", "left")
    wrong = F.raise_error(F.concat(F.lit("the header does not end in the first block of "), "file_path"))
    # The first record of the whole file must be the one that the first block alone gives.
    after_header = (
        F.when(F.col("pos") > 0, F.lit(True))
        .when(F.col("line") == F.col("header"), F.lit(False))
        .otherwise(wrong.cast("boolean"))
    )
    return bound.where(after_header).select("file_path", "header", "pos", "line")
