"""Ordered scans over groups too large for one task.

A plain window puts a whole group into one task. Here rows are range-split by (group, order), the split is
written to the checkpoint folder so that every later stage sees the same cut, each piece is scanned alone,
and the state entering a piece comes from a summary with one row per (group, piece).
Groups that one task can put in order are not split: their rows carry no piece, and the scans are plain windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

PIECE = "_piece"
GROUP_ROWS = 1 << 20  #: rows of a group that one task puts in order


def split_ordered(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-split by group and order; ``order`` should identify a row inside its group."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*[F.col(x) for x in (*group, *order)])
    return ranged.withColumn(PIECE, F.spark_partition_id()).checkpoint()


def split_large(df: DataFrame, group: Sequence[str], order: Sequence[str], limit: int = GROUP_ROWS) -> list[DataFrame]:
    """All rows in one or two tables: groups of at most ``limit`` rows as they are, and, if there are any, larger ones split.

    The names of the larger groups come to the driver: fewer than one for ``limit`` rows.
    """
    names = {g: f"_large_{g}" for g in group}
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*[F.col(g).alias(n) for g, n in names.items()])
    found = sizes.collect()
    if not found:
        return [df]
    large = F.broadcast(df.sparkSession.createDataFrame(found, sizes.schema))
    same = F.lit(True)
    for g, n in names.items():
        same = same & F.col(g).eqNullSafe(F.col(n))
    return [df.join(large, same, "left_anti"), split_ordered(df.join(large, same, "left_semi"), group, order)]


def _piece_window(group: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*group, PIECE).orderBy(*order)


def _entering(pieces: DataFrame, group: Sequence[str], summary: Column, carried) -> DataFrame:
    """Per (group, piece) the ``carried`` window result over the summaries of earlier pieces."""
    per_piece = pieces.groupBy(*group, PIECE).agg(summary.alias("_s"))
    w = Window.partitionBy(*group).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    return per_piece.select(*group, PIECE, carried(F.col("_s")).over(w).alias("_in"))


def _with_entry(pieces: DataFrame, entry: DataFrame, group: Sequence[str]) -> DataFrame:
    cond = F.col(f"_e{PIECE}") == F.col(PIECE)
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_e_{g}"))
    renamed = entry.select(*[F.col(g).alias(f"_e_{g}") for g in group], F.col(PIECE).alias(f"_e{PIECE}"), "_in")
    return pieces.join(renamed, cond, "left").drop(*[f"_e_{g}" for g in group], f"_e{PIECE}")


def numbered(pieces: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Row number from 1 inside each group."""
    if PIECE not in pieces.columns:
        return pieces.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    entry = _entering(pieces, group, F.count(F.lit(1)), F.sum)
    w = _piece_window(group, order)
    return (
        _with_entry(pieces, entry, group)
        .withColumn(name, F.row_number().over(w) + F.coalesce("_in", F.lit(0)))
        .drop("_in")
    )


def running_sum(pieces: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` up to and including the row."""
    if PIECE not in pieces.columns:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return pieces.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))
    entry = _entering(pieces, group, F.sum(value), F.sum)
    w = _piece_window(group, order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _with_entry(pieces, entry, group)
        .withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)) + F.coalesce("_in", F.lit(0)))
        .drop("_in")
    )


def earlier_max(pieces: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Greatest ``value`` of the rows before this one; NULL for the first."""
    entry = _entering(pieces, group, F.max(value), F.max)
    w = _piece_window(group, order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        _with_entry(pieces, entry, group)
        .withColumn("_here", F.max(value).over(w))
        .withColumn(name, F.greatest("_here", "_in"))
        .drop("_in", "_here")
    )


def previous(pieces: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``value`` of the row before this one; NULL for the first."""
    packed = F.struct(*[F.col(o) for o in order], value.alias("_v"))
    entry = _entering(pieces, group, F.max(packed), F.max)
    w = _piece_window(group, order)
    first = F.row_number().over(w) == 1
    return (
        _with_entry(pieces, entry, group)
        .withColumn(name, F.when(first, F.col("_in")["_v"]).otherwise(F.lag(value).over(w)))
        .drop("_in")
    )
