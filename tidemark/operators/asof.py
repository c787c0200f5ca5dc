"""As-of reads: a row counts at a moment only when it was already known then.

Two shapes of question:

* **Grid**: all keys are asked at the same few moments (rebalance dates). Each fact is snapped to the first
  moment that can see it, revisions are merged per snap (map-side combine, so a key holding a large share of
  the rows shrinks before the shuffle), and what is left per key is bounded by the grid length.
* **Per row**: every left row brings its own moment. ``asof_join`` cuts time into chunks, so one hot key is
  spread over tasks; the value carried into a chunk comes from a small per-chunk summary.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVISION_ORDER = ("ingestion_time", "data_version", "close", "volume")


def _clamped(day: datetime, months: int) -> datetime:
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    month += 1
    first_of_next = datetime(year + month // 12, month % 12 + 1, 1)
    last = (first_of_next - datetime(year, month, 1)).days
    return day.replace(year=year, month=month, day=min(day.day, last))


def rebalance_grid(start: datetime, end: datetime, step_months: int) -> list[datetime]:
    """start, then step by step while < end; each step clamps the day of the previous date."""
    out, day = [], start
    while day < end:
        out.append(day)
        day = _clamped(day, step_months)
    return out


def grid_array(grid: Sequence[datetime]) -> Column:
    return F.array(*[F.lit(g.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp") for g in sorted(grid)])


def moments_below(grid: Sequence[datetime], x, inclusive: bool = True) -> Column:
    """How many grid moments are at or before ``x`` (before it without ``inclusive``).

    A balanced tree of comparisons, so it stays in generated code and costs a handful of them per row,
    where a lambda over the grid would be interpreted once per moment.
    """
    x = F.col(x) if isinstance(x, str) else x
    ordered = [F.lit(g.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp") for g in sorted(grid)]

    def count(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        below = ordered[mid] <= x if inclusive else ordered[mid] < x
        return F.when(below, count(mid + 1, hi)).otherwise(count(lo, mid))

    return count(0, len(ordered))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator. The optimizer would otherwise copy their expressions into every later use,
    and a comparison tree over a copied expression grows past what the JVM compiles."""
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))


def moments_between(grid: Sequence[datetime], first: Column, last: Column) -> Column:
    """Grid moments with 1-based places first..last; empty when last < first."""
    return F.slice(grid_array(grid), first, F.greatest(last - first + 1, F.lit(0)))


def newest_revision(bars: DataFrame, *keys: str, order: Sequence[str] = REVISION_ORDER) -> DataFrame:
    """One row per key: the revision with the greatest order columns."""
    rest = [x for x in bars.columns if x not in keys and x not in order]
    packed = F.struct(*order, *rest)
    top = bars.groupBy(*keys).agg(F.max(packed).alias("_r"))
    return top.select(*keys, *[F.col("_r")[x].alias(x) for x in bars.columns if x not in keys])


def known_bars(
    revisions: DataFrame,
    grid: Sequence[datetime],
    days: int,
    flags: DataFrame | None = None,
    forward: bool = False,
) -> DataFrame:
    """Revisions that some moment's window holds, with the places of the first and last such moment (``_first``, ``_last``).

    Revisions of a bar first seen at the same moment are merged, on the map side before they are shuffled.
    """
    if flags is not None:
        critical = flags.filter(F.col("severity") == "CRITICAL").select("security_id", "ts").distinct()
        revisions = revisions.join(critical, ["security_id", "ts"], "left_anti")
    span = F.make_dt_interval(F.lit(days))
    known = F.greatest("ts", "available_time")
    # moments from _lo to _hi can see the bar; both ends are computed once per row
    low, high = (known - span, F.col("ts")) if forward else (known, F.col("ts") + span)
    ranged = once(revisions, _lo=low, _hi=high)
    placed = once(ranged, _first=moments_below(grid, "_lo", inclusive=False) + 1, _last=moments_below(grid, "_hi"))

    snapped = placed.filter(F.col("_first") <= F.col("_last")).drop("_lo", "_hi")
    # revisions first seen at the same moment compete at every later one too
    return newest_revision(snapped, "security_id", "ts", "_first", "_last")


def bars_on_grid(
    revisions: DataFrame,
    grid: Sequence[datetime],
    days: int,
    flags: DataFrame | None = None,
    forward: bool = False,
) -> DataFrame:
    """Bars visible at each grid moment: ``(security_id, as_of, ts, ...)``, newest known revision per bar.

    Looks ``days`` back from the moment; with ``forward`` it covers [as_of, as_of + days] as known at the end
    of that range. Bars with a CRITICAL flag are dropped before revisions are merged.
    """
    merged = known_bars(revisions, grid, days, flags, forward)
    probed = merged.withColumn("as_of", F.explode(moments_between(grid, F.col("_first"), F.col("_last")))).drop("_first", "_last")
    # at most (bars in the span x moments) rows per (security, moment) are left here: safe to co-locate
    together = probed.repartition("security_id", "as_of")
    return newest_revision(together, "security_id", "as_of", "ts")


def facts_on_grid(
    facts: DataFrame,
    grid: Sequence[datetime],
    keys: Sequence[str],
    order: Sequence[str],
    known: str = "available_time",
) -> DataFrame:
    """For each key and moment the known fact with the greatest ``order`` columns.

    Facts merge per first visible moment, a running maximum carries them forward (one row per key and
    moment at most), and each winner is spread over the moments until the next one.
    """
    rest = [x for x in facts.columns if x not in keys and x not in order]
    packed = F.struct(*order, *rest)
    snapped = (
        once(once(facts, _known=F.col(known)), _first=moments_below(grid, "_known", inclusive=False) + 1)
        .filter(F.col("_first") <= len(grid))
        .groupBy(*keys, "_first")
        .agg(F.max(packed).alias("_r"))
    )
    by_key = Window.partitionBy(*keys).orderBy("_first")
    carried = snapped.select(
        *keys,
        "_first",
        F.coalesce(F.lead("_first").over(by_key), F.lit(len(grid) + 1)).alias("_next"),
        F.max("_r").over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("_r"),
    )
    spread = carried.select(*keys, F.explode(moments_between(grid, F.col("_first"), F.col("_next") - 1)).alias("as_of"), "_r")
    return spread.select(*keys, "as_of", *[F.col("_r")[x].alias(x) for x in facts.columns if x not in keys])


def history_on_grid(facts: DataFrame, grid: Sequence[datetime], known: str = "available_time", until: Column | None = None) -> DataFrame:
    """Every fact repeated at each grid moment that can see it, up to its last moment of use where ``until`` names one.

    A reader of a window gives ``until``, so that a fact is repeated as often as windows hold it, not to the end of the
    grid. A NULL ``until`` sets no end.
    """
    end = F.lit(None).cast("timestamp") if until is None else until.cast("timestamp")
    ranged = once(facts, _known=F.col(known), _until=end)
    last = F.when(F.col("_until").isNull(), F.lit(len(grid))).otherwise(moments_below(grid, "_until"))
    placed = once(ranged, _first=moments_below(grid, "_known", inclusive=False) + 1, _last=last).drop("_known", "_until")
    used = placed.filter(F.col("_first") <= F.col("_last"))
    return used.withColumn("as_of", F.explode(moments_between(grid, F.col("_first"), F.col("_last")))).drop("_first", "_last")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    tie: Sequence[str] = (),
    strict: bool = False,
    chunk: str = "month",
) -> DataFrame:
    """Left rows with the last right row at or before (``strict``: before) their time; NULLs where none.

    ``chunk`` is the time slice one task sorts for one key; choose a finer one for denser keys.
    """
    payload = [x for x in right.columns if x not in keys]
    r = right.select(
        *keys,
        F.date_trunc(chunk, F.col(right_time)).alias("_slice"),
        F.col(right_time).alias("_t"),
        F.struct(F.col(right_time).alias("_rt"), *[F.col(x).alias(f"_tie_{x}") for x in tie], *payload).alias("_r"),
    )
    lft = left.withColumn("_slice", F.date_trunc(chunk, F.col(left_time)))
    per_slice = r.groupBy(*keys, "_slice").agg(F.max("_r").alias("_r"))
    asked = lft.select(*keys, "_slice").distinct().withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType))
    by_slice = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        per_slice.unionByName(asked)
        .groupBy(*keys, "_slice")
        .agg(F.max("_r").alias("_r"))
        .withColumn("_carry", F.max("_r").over(by_slice))
        .drop("_r")
    )
    own = F.struct(*[F.col(x) for x in left.columns])
    first, second = (0, 1) if not strict else (1, 0)
    mixed = (
        r.select(*keys, "_slice", "_t", F.lit(first).alias("_o"), "_r")
        .withColumn("_l", F.lit(None).cast(lft.select(own.alias("x")).schema["x"].dataType))
        .unionByName(
            lft.select(*keys, "_slice", F.col(left_time).alias("_t"), F.lit(second).alias("_o"), own.alias("_l"))
            .withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType))
        )
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        mixed.withColumn("_here", F.max("_r").over(inside))
        .filter(F.col("_l").isNotNull())
        .join(carry, [*keys, "_slice"], "left")
        .withColumn("_hit", F.coalesce("_here", "_carry"))
    )
    return found.select(
        *[F.col("_l")[x].alias(x) for x in left.columns],
        *[F.col("_hit")[x].alias(x) for x in payload if x not in left.columns],
    )


def calendar_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, strict: bool = False) -> DataFrame:
    """As-of join without a key against a table with at most one row per moment of a calendar.

    The right rows become intervals, cut into the days they cover: that side has about one row per calendar
    day whatever the left side holds, so it is broadcast and the left side is not moved at all.
    """
    payload = right.columns
    rt = F.col(right_time)
    spans = right.select(rt.alias("_from"), F.lead(rt).over(Window.orderBy(rt)).alias("_to"), F.struct(*payload).alias("_r"))
    days = spans.filter(F.col("_to").isNotNull()).withColumn("_day", F.explode(F.sequence(F.to_date("_from"), F.to_date("_to"))))
    last = spans.filter(F.col("_to").isNull()).select(F.lit(1).alias("_k"), F.col("_from").alias("_last"), F.col("_r").alias("_last_r"))
    lt = F.col(left_time)
    inside = (lt > F.col("_from")) & (lt <= F.col("_to")) if strict else (lt >= F.col("_from")) & (lt < F.col("_to"))
    hit = left.withColumn("_k", F.lit(1)).join(F.broadcast(days), (F.to_date(lt) == F.col("_day")) & inside, "left")
    hit = hit.join(F.broadcast(last), "_k", "left")
    after = lt > F.col("_last") if strict else lt >= F.col("_last")
    found = hit.withColumn("_hit", F.when(after, F.col("_last_r")).otherwise(F.col("_r")))
    return found.select(*left.columns, *[F.col("_hit")[x].alias(x) for x in payload if x not in left.columns])


def _mirror(col: str) -> Column:
    return F.timestamp_micros(-F.unix_micros(F.col(col)))


def next_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, chunk: str = "month"
) -> DataFrame:
    """Left rows with the first right row at or after their time: ``asof_join`` on mirrored clocks."""
    lft = left.withColumn("_lm", _mirror(left_time))
    rgt = right.withColumn("_rm", _mirror(right_time))
    return asof_join(lft, rgt, keys, "_lm", "_rm", chunk=chunk).drop("_lm", "_rm")
