"""Windows of bars per (security, moment), the common input of price factors."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import change, fallback_null, fallback_zero
from tidemark.operators.asof import bars_on_grid


def padded(lookback: int) -> int:
    """Calendar days read for a lookback of trading days."""
    return int(lookback * 1.6)


def bar_panel(
    revisions: DataFrame,
    grid: Sequence[datetime],
    pad_days: int,
    keep: int | None,
    flags: DataFrame | None = None,
) -> DataFrame:
    """Last ``keep`` bars per (security, moment) with ``rn`` (1 = newest), ``px`` and the daily return.

    A window holds at most one bar per day of the pad, so the sort per group stays small for any security.
    """
    seen = bars_on_grid(revisions, grid, pad_days, flags)
    newest_first = Window.partitionBy("security_id", "as_of").orderBy(F.desc("ts"))
    ranked = seen.withColumn("rn", F.row_number().over(newest_first))
    if keep is not None:
        ranked = ranked.filter(F.col("rn") <= keep)
    by_time = Window.partitionBy("security_id", "as_of").orderBy("ts")
    return (
        ranked.withColumn("px", fallback_zero("adjusted_close", "close"))
        .withColumn("px_null", fallback_null("adjusted_close", "close"))
        .withColumn("prev_px", F.lag("px").over(by_time))
        .withColumn("ret", change("px", "prev_px"))
    )


def market_panel(
    revisions: DataFrame,
    benchmark: DataFrame,
    grid: Sequence[datetime],
    lookback: int,
) -> DataFrame:
    """Security and benchmark prices on the dates both windows hold, with returns over those dates.

    The benchmark side has one row per day and moment, far below any security table.
    """
    own = bar_panel(revisions, grid, padded(lookback), lookback + 1).select("security_id", "as_of", "ts", "px")
    market = bar_panel(benchmark, grid, padded(lookback), lookback + 1).select(
        F.col("as_of"), F.col("ts"), F.col("px").alias("mpx")
    )
    by_time = Window.partitionBy("security_id", "as_of").orderBy("ts")
    both = own.join(market, ["as_of", "ts"])
    return (
        both.withColumn("s", change("px", F.lag("px").over(by_time)))
        .withColumn("m", change("mpx", F.lag("mpx").over(by_time)))
        .withColumn("day_no", F.row_number().over(by_time))
    )
