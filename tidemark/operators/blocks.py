"""Long price windows from mergeable block aggregates.

A window of years holds a bar at every moment of the grid, so a panel would repeat it once for each. Here a bar is
shuffled once, to its block (security and calendar month or quarter). There its versions get the places of the moments
that see them, bars with the same places are summed up together, and what is repeated at the moments is the block's
aggregates: a few rows a block. A window of the newest ``keep`` bars ends inside one block of each moment; for that one
the aggregate is taken again from its bars.

``run_of_moves`` does the same for sequences: a block's moves over a fixed number of bars are summed inside it, and its first
and last bars are kept, so that moves across a border are added when blocks are put in a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import change, fallback_zero, ratio
from tidemark.operators.asof import REVISION_ORDER, grid_array, known_bars
from tidemark.operators.panel import padded

BLOCK = ("security_id", "block")
PLACE = ("security_id", "place")


@dataclass(frozen=True)
class Part:
    """An aggregate that merges: ``of`` bars, then of itself."""

    name: str
    of: Column
    merge: str  # sum, min or max

    def again(self) -> Column:
        return getattr(F, self.merge)(self.name).alias(self.name)


def basics() -> list[Part]:
    """Number of bars, oldest and newest one, and the greatest positive close."""
    bar = F.struct("ts", "px", "close")
    return [
        Part("n", F.count(F.lit(1)), "sum"),
        Part("oldest", F.min(bar), "min"),
        Part("newest", F.max(bar), "max"),
        Part("top", F.max(F.when(F.col("close") > 0, F.col("close"))), "max"),
    ]


def block_bars(revisions: DataFrame, grid: Sequence[datetime], days: int, unit: str, flags: DataFrame | None = None) -> DataFrame:
    """(security_id, block, ts, px, close, first, last): each version of a bar with the places of the moments that take it.

    ``unit`` is the calendar unit of a block. Rows are co-located by block.
    """
    merged = known_bars(revisions, grid, days, flags)
    placed = merged.withColumn("block", F.date_trunc(unit, "ts")).repartition(*BLOCK)
    by_bar = Window.partitionBy(*BLOCK, "ts").orderBy("_first")
    rest = [c for c in merged.columns if c not in ("security_id", "ts", "_first", "_last", *REVISION_ORDER)]
    newest = F.max(F.struct(*REVISION_ORDER, *rest)).over(by_bar.rowsBetween(Window.unboundedPreceding, 0))
    spans = placed.select(*BLOCK, "ts", newest.alias("_v"), F.col("_first").alias("first"), F.coalesce(F.lead("_first").over(by_bar) - 1, F.col("_last")).alias("last"))
    # a block of bars is bounded by the calendar unit; an earlier revision may have ended before the window of its bar does
    return spans.select(*BLOCK, "ts", fallback_zero(F.col("_v.adjusted_close"), F.col("_v.close")).alias("px"), F.col("_v.close").alias("close"), "first", "last")


def at_places(blocks: DataFrame, parts: Sequence[Part]) -> DataFrame:
    """Aggregates of the bars that each place takes, by block: (security_id, place, block, parts). The rows that move are summed up."""
    classes = blocks.groupBy(*BLOCK, "first", "last").agg(*[p.of.alias(p.name) for p in parts])
    spread = classes.repartition("security_id").withColumn("place", F.explode(F.sequence("first", "last")))
    return spread.groupBy(*PLACE, "block").agg(*[p.again() for p in parts])


def cut_blocks(rows: DataFrame, keep: int) -> DataFrame:
    """Rows of :func:`at_places` with the number ``room`` of bars that are wanted of each block: all, some or none of them."""
    newer = Window.partitionBy(*PLACE).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("room", F.lit(keep) - F.coalesce(F.sum("n").over(newer), F.lit(0))).where(F.col("room") > 0)


def newest_of(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The newest ``room`` bars of the blocks in ``wanted`` (security_id, place, block, room), as those places take them."""
    seen = blocks.join(wanted.select(*PLACE, "block", "room"), list(BLOCK)).where("place between first and last")
    newest = Window.partitionBy(*BLOCK, "place").orderBy(F.desc("ts"))
    return seen.withColumn("_rank", F.row_number().over(newest)).where("_rank <= room").drop("_rank", "room")


def windows(blocks: DataFrame, keep: int | None, parts: Sequence[Part]) -> DataFrame:
    """(security_id, place, parts) over each window's newest ``keep`` bars, or all of them."""
    rows = at_places(blocks, parts)
    if keep is None:
        return rows.groupBy(*PLACE).agg(*[p.again() for p in parts])
    rows = cut_blocks(rows, keep)
    whole = rows.where("n <= room").groupBy(*PLACE).agg(*[p.again() for p in parts])
    edge = newest_of(blocks, rows.where("n > room")).groupBy(*BLOCK, "place").agg(*[p.of.alias(p.name) for p in parts]).drop("block")
    return whole.unionByName(edge).groupBy(*PLACE).agg(*[p.again() for p in parts])


def with_moment(rows: DataFrame, grid: Sequence[datetime]) -> DataFrame:
    return rows.withColumn("as_of", F.element_at(grid_array(grid), F.col("place").cast("int")))


def long_window(revisions: DataFrame, grid: Sequence[datetime], pad: int, keep: int | None, flags: DataFrame | None = None, unit: str = "quarter") -> DataFrame:
    """(security_id, as_of, n, oldest, newest, top) of long windows; oldest and newest are (ts, px, close)."""
    return with_moment(windows(block_bars(revisions, grid, pad, unit, flags), keep, basics()), grid).drop("place")


# ---- factors ---------------------------------------------------------------------------------


def _scored(rows: DataFrame, score: Column) -> DataFrame:
    return rows.select("security_id", "as_of", score.alias("score"))


def long_term_reversal(revisions: DataFrame, grid: Sequence[datetime], lookback: int = 36 * 21, flags: DataFrame | None = None) -> DataFrame:
    """Negative return over the newest lookback + 1 bars, at least two."""
    rows = long_window(revisions, grid, padded(lookback), lookback + 1, flags)
    return _scored(rows, F.when(F.col("n") >= 2, -change("newest.px", "oldest.px")))


def long_term_momentum(revisions: DataFrame, grid: Sequence[datetime], lookback: int = 12 * 21, flags: DataFrame | None = None) -> DataFrame:
    """Return over the newest lookback + 1 bars of twice as many days, at least two."""
    rows = long_window(revisions, grid, 2 * lookback, lookback + 1, flags)
    return _scored(rows, F.when(F.col("n") >= 2, change("newest.px", "oldest.px")))


def year_high(revisions: DataFrame, grid: Sequence[datetime], lookback: int = 252, flags: DataFrame | None = None) -> DataFrame:
    """Newest close over the greatest one of the window."""
    rows = long_window(revisions, grid, padded(lookback), lookback + 1, flags)
    return _scored(rows, F.when((F.col("n") >= 2) & (F.col("newest.close") > 0), ratio("newest.close", "top")))


def return_seasonality(revisions: DataFrame, grid: Sequence[datetime], years: int = 5, least: int = 2, flags: DataFrame | None = None) -> DataFrame:
    """Mean return of the moment's calendar month in earlier years, at least ``least`` of them.

    A month is a block, so its last price is one of its aggregates. A window without such months scores NULL.
    """
    blocks = block_bars(revisions, grid, years * 366 + 40, "month", flags)
    last = Part("newest", F.max(F.struct("ts", "px")), "max")
    rows = with_moment(at_places(blocks, [last]), grid)
    age = (F.year("as_of") - F.year("block")) * 12 + F.month("as_of") - F.month("block")
    parts = []
    for year in range(1, years + 1):
        of = lambda months: F.max(F.when(age == months, F.col("newest.px")))
        before = of(12 * year + 1)
        parts.append(F.when(before > 0, change(of(12 * year), before)))
    found = rows.groupBy("security_id", "as_of").agg(F.array_compact(F.array(*parts)).alias("known"))
    total = F.aggregate("known", F.lit(0.0), lambda a, x: a + x)
    return _scored(found, F.when(F.size("known") >= least, F.try_divide(total, F.size("known"))))


# ---- moves over several bars -----------------------------------------------------------------

MOVES = ("moves", "s", "m", "ss", "mm", "sm")


def _product_sums(moves: Column) -> Column:
    """Number, sums and products of an array of moves (s, m)."""
    zero = F.struct(*[F.lit(0.0).alias(x) for x in MOVES])
    add = lambda a, x: F.struct(
        (a["moves"] + 1).alias("moves"), (a["s"] + x["s"]).alias("s"), (a["m"] + x["m"]).alias("m"),
        (a["ss"] + x["s"] * x["s"]).alias("ss"), (a["mm"] + x["m"] * x["m"]).alias("mm"), (a["sm"] + x["s"] * x["m"]).alias("sm"),
    )
    return F.aggregate(F.filter(moves, lambda x: x["s"].isNotNull() & x["m"].isNotNull()), zero, add)


def _move(new: Column, old: Column) -> Column:
    return F.struct((F.ln(new["px"]) - F.ln(old["px"])).alias("s"), (F.ln(new["mpx"]) - F.ln(old["mpx"])).alias("m"))


def run_of_moves(rows: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """Of each run of bars (px, mpx by ts): how many, least prices, sums over moves inside it, its first and last ``horizon`` bars."""
    by_time = Window.partitionBy(*keys).orderBy("ts")
    rows = rows.withColumn("_bar", F.struct("ts", "px", "mpx")).withColumn("_no", F.row_number().over(by_time)).withColumn("_old", F.lag("_bar", horizon).over(by_time))
    rows = rows.withColumn("_left", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"))))
    s, m = (F.ln(x) - F.ln(F.col("_old")[x]) for x in ("px", "mpx"))
    both = s.isNotNull() & m.isNotNull()
    s, m = F.when(both, s), F.when(both, m)
    sums = [F.count(s).cast("double"), *[F.coalesce(F.sum(x), F.lit(0.0)) for x in (s, m, s * s, m * m, s * m)]]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.least(F.min("px"), F.min("mpx")).alias("low"), F.struct(*[x.alias(k) for k, x in zip(MOVES, sums, strict=True)]).alias("inner"),
        F.array_sort(F.collect_list(F.when(F.col("_no") <= horizon, F.col("_bar")))).alias("head"), F.array_sort(F.collect_list(F.when(F.col("_left") <= horizon, F.col("_bar")))).alias("tail"),
    )


def same_places(common: DataFrame) -> DataFrame:
    """Bars repeated for each span of places over which their block's bars stay the same (``since``, ``until``); most blocks have two or three."""
    starts = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("first", F.col("last") + 1)).over(Window.partitionBy(*BLOCK)))))
    spans = common.withColumn("_starts", starts).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_starts") - 1)))
    spans = spans.withColumn("since", F.col("_starts")[F.col("_i") - 1]).withColumn("until", F.col("_starts")[F.col("_i")] - 1)
    return spans.where("since >= first and until <= last").drop("_starts", "_i")


def oldest_kept(blocks: DataFrame, keep: int, name: str) -> DataFrame:
    """(security_id, place, name): time of the oldest of the newest ``keep`` bars, where a window has more than that."""
    rows = cut_blocks(at_places(blocks, [Part("n", F.count(F.lit(1)), "sum"), Part("oldest", F.min("ts"), "min")]), keep)
    edge = newest_of(blocks, rows.where("n > room")).groupBy(*BLOCK, "place").agg(F.min("ts").alias("oldest")).drop("block")
    every = rows.where("n <= room").select(*PLACE, "oldest").unionByName(edge)
    return every.groupBy(*PLACE).agg(F.min("oldest").alias(name))


def betting_against_correlation(revisions: DataFrame, benchmark: DataFrame, grid: Sequence[datetime], lookback: int = 1260, least: int = 750, horizon: int = 3, unit: str = "quarter") -> DataFrame:
    """Negative correlation of overlapping log returns over ``horizon`` common bars of security and benchmark.

    The benchmark's side has one row a day and version, and is broadcast: the calendar bounds it.
    """
    own, market = (block_bars(x, grid, padded(lookback), unit) for x in (revisions, benchmark))
    mine = oldest_kept(own, lookback + 1, "oldest")
    theirs = oldest_kept(market, lookback + 1, "oldest_market").drop("security_id")
    cut = mine.join(F.broadcast(theirs), "place").select(*PLACE, F.greatest("oldest", "oldest_market").alias("cut"))

    days = market.select("ts", F.col("px").alias("mpx"), F.col("first").alias("_f"), F.col("last").alias("_l"))
    common = own.drop("close").join(F.broadcast(days), "ts").withColumns({"first": F.greatest("first", "_f"), "last": F.least("last", "_l")}).where("first <= last").drop("_f", "_l")
    runs = run_of_moves(same_places(common), [*BLOCK, "since", "until"], horizon)
    placed = runs.withColumn("place", F.explode(F.sequence("since", "until"))).drop("since", "until").join(cut, list(PLACE))
    of_cut = F.date_trunc(unit, "cut")
    whole = placed.where(F.col("block") > of_cut).drop("cut")
    edge = common.join(cut.withColumn("block", of_cut), list(BLOCK)).where("place between first and last and ts >= cut")
    whole = whole.unionByName(run_of_moves(edge, [*BLOCK, "place"], horizon))

    earlier = Window.partitionBy(*PLACE).orderBy("block").rowsBetween(-horizon, -1)
    before = F.flatten(F.collect_list("tail").over(earlier))  # each block has a bar, so these hold the last ones
    chain = whole.withColumn("_before", before).withColumn("_chain", F.concat("_before", "head"))
    start = F.size("_before")
    across = F.transform(F.sequence(F.lit(0), F.size("head") - 1), lambda i: F.when(start + i >= horizon, _move(F.element_at("_chain", (start + i + 1).cast("int")), F.element_at("_chain", (F.greatest(start + i - horizon, F.lit(0)) + 1).cast("int")))))
    summed = chain.withColumn("_across", _product_sums(F.filter(across, lambda x: x.isNotNull())))
    total = {x: F.sum(F.col("inner")[x] + F.col("_across")[x]).alias(x) for x in MOVES}
    sums = summed.groupBy(*PLACE).agg(F.sum("n").alias("n"), F.min("low").alias("low"), *total.values())
    n = F.col("moves")
    spread = lambda a, aa: F.col(aa) / n - (F.col(a) / n) * (F.col(a) / n)
    corr = F.try_divide(F.col("sm") / n - F.col("s") / n * F.col("m") / n, F.sqrt(spread("s", "ss") * spread("m", "mm")))
    enough = (F.col("n") >= least) & (F.col("low") > 0) & (n >= 2)
    return _scored(with_moment(sums, grid), F.when(enough, F.when((spread("s", "ss") > 0) & (spread("m", "mm") > 0), -corr)))
