"""Point-in-time reads of the research tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators.asof import asof_join, calendar_join, facts_on_grid, history_on_grid, moments_below, moments_between, once


def critical_times(flags: DataFrame) -> DataFrame:
    return flags.filter(F.col("severity") == "CRITICAL").select("security_id", "ts").distinct()


def spans_on_grid(spans: DataFrame, grid: Sequence[datetime], start="valid_from", end="valid_to", closed=False) -> DataFrame:
    """Validity rows repeated at each grid moment they contain: a projection, no join."""
    last = F.when(F.col("_e").isNull(), F.lit(len(grid))).otherwise(moments_below(grid, "_e", inclusive=closed))
    placed = once(once(spans, _s=F.col(start), _e=F.col(end)), _first=moments_below(grid, "_s", inclusive=False) + 1, _last=last)
    out = placed.withColumn("as_of", F.explode(moments_between(grid, F.col("_first"), F.col("_last"))))
    return out.drop("_s", "_e", "_first", "_last")


def security_on_grid(master: DataFrame, grid) -> DataFrame:
    """Master row valid at the moment, the newest valid_from winning."""
    valid = spans_on_grid(master, grid)
    rest = [x for x in master.columns if x not in ("security_id", "valid_from")]
    top = valid.groupBy("security_id", "as_of").agg(F.max(F.struct("valid_from", *rest)).alias("r"))
    return top.select("security_id", "as_of", "r.*")


def universe_on_grid(membership: DataFrame, grid) -> DataFrame:
    return spans_on_grid(membership, grid).select("universe", "as_of", "security_id").distinct()


def actions_on_grid(actions: DataFrame, grid, days: int) -> DataFrame:
    """Actions known at the moment whose effective (else event) time lies in the days before it."""
    when = F.coalesce("effective_time", "event_time")
    seen = history_on_grid(actions, grid, until=when + F.make_dt_interval(F.lit(days)))
    inside = (when >= F.col("as_of") - F.make_dt_interval(F.lit(days))) & (when <= F.col("as_of"))
    return seen.filter(when.isNull() | inside)


def benchmark_on_grid(benchmark: DataFrame, grid, days: int) -> DataFrame:
    seen = history_on_grid(benchmark, grid, until=F.col("ts") + F.make_dt_interval(F.lit(days)))
    return seen.filter((F.col("ts") >= F.col("as_of") - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= F.col("as_of")))


def member_bars(bars: DataFrame, membership: DataFrame, benchmark_id: str | None = None) -> DataFrame:
    """Bars of days on which the security is a member; the benchmark always passes."""
    m = membership.select(F.col("security_id").alias("_m"), "valid_from", "valid_to")
    inside = (F.col("security_id") == F.col("_m")) & (F.col("ts") >= F.col("valid_from")) & (
        F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to"))
    )
    kept = bars.join(m, inside, "left_semi")
    return kept if benchmark_id is None else kept.unionByName(bars.filter(F.col("security_id") == benchmark_id))


# ---- macro vintages ------------------------------------------------------------------------------


def series_on_grid(vintages: DataFrame, grid) -> DataFrame:
    """Newest known vintage per observation; NULL and withdrawn ones are dropped after the pick."""
    picked = facts_on_grid(vintages, grid, ["series_id", "observation_date"], ["realtime_start", "available_time"])
    gone = F.col("realtime_end") + F.make_dt_interval(F.lit(2), F.lit(6))  # end + 1 day, known 1 day 6 h later
    return picked.filter(F.col("value").isNotNull() & (F.col("realtime_end").isNull() | (gone > F.col("as_of"))))


def latest_on_grid(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id", "as_of").agg(
        F.max("observation_date").alias("observation_date"), F.max_by("value", "observation_date").alias("value")
    )


def with_fallback_lag(vintages: DataFrame, lag_days: int) -> DataFrame:
    """For never-revised series: observations before the first vintage become known a fixed lag after their date."""
    first = vintages.groupBy("series_id").agg(F.min("realtime_start").alias("first_vintage"))
    early = (F.col("realtime_start") == F.col("first_vintage")) & (F.col("observation_date") < F.col("first_vintage"))
    lagged = F.col("observation_date") + F.make_dt_interval(F.lit(lag_days + 1), F.lit(6))
    known = F.when(early, F.least("available_time", lagged)).otherwise(F.col("available_time"))
    return vintages.join(first, "series_id").withColumn("available_time", known).drop("first_vintage")


def rate_before(probes: DataFrame, rates: DataFrame, at: str, max_stale_days: int = 10) -> DataFrame:
    """Last rate strictly before the day, at most ``max_stale_days`` old, as a fraction."""
    r = rates.select(F.col("ts").alias("rate_day"), F.col("rate").alias("_rate"))
    hit = calendar_join(probes, r, at, "rate_day", strict=True)
    fresh = F.datediff(F.col(at), F.col("rate_day")) <= max_stale_days
    return hit.withColumn("annual_rate", F.when(fresh, F.col("_rate") / 100.0)).drop("_rate")


# ---- index membership ------------------------------------------------------------------------------


def snapshot_before(probes: DataFrame, snapshots: DataFrame, at: str) -> DataFrame:
    """Last snapshot day at or before each probe with its age in days; members are joined by that day."""
    hit = calendar_join(probes, snapshots.select("snapshot").distinct(), at, "snapshot")
    return hit.withColumn("stale_days", F.datediff(F.col(at), F.col("snapshot")))


def removed_since(intervals: DataFrame, since: Column) -> DataFrame:
    return intervals.filter(F.col("end_date").isNotNull() & (F.col("end_date") >= since))


def renamed(intervals: DataFrame, renames: DataFrame) -> DataFrame:
    r = renames.select(F.col("old_ticker").alias("ticker"), "new_ticker")
    return intervals.join(r, "ticker", "left").withColumn("ticker", F.coalesce("new_ticker", "ticker")).drop("new_ticker")


def members_with_prices(intervals: DataFrame, bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Per 1 January the members, how many have bars at all, and the ratio.

    Open intervals last until the newest ``ts`` of the calendar, by default of the bars.
    """
    priced = bars.select(F.col("security_id").alias("ticker")).distinct().withColumn("priced", F.lit(1))
    last = (bars if calendar is None else calendar).agg(F.max("ts").alias("last"))
    years = F.sequence(F.year("start_date"), F.greatest(F.year("start_date"), F.year(F.coalesce("end_date", "last"))))
    y = intervals.crossJoin(F.broadcast(last)).select("ticker", "start_date", "end_date", F.explode(years).alias("year"))
    jan = F.make_timestamp(F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    on = y.filter((F.col("start_date") <= jan) & (F.col("end_date").isNull() | (jan <= F.col("end_date"))))
    members = on.select("year", "ticker").distinct().join(priced, "ticker", "left")
    g = members.groupBy("year").agg(F.count(F.lit(1)).alias("members"), F.count("priced").alias("with_prices"))
    return g.withColumn("coverage", ratio("with_prices", "members"))


def removed_coverage(intervals: DataFrame, bars: DataFrame, since: Column) -> DataFrame:
    """Removed tickers split into those with and without prices."""
    gone = removed_since(intervals, since).select("ticker").distinct()
    priced = bars.select(F.col("security_id").alias("ticker")).distinct().withColumn("p", F.lit(1))
    return gone.join(priced, "ticker", "left").agg(
        F.count(F.lit(1)).alias("removed"), F.count("p").alias("covered"), ratio(F.count("p") * 100, F.count(F.lit(1))).alias("percentage")
    )


def listing_overlap(intervals: DataFrame, listings: DataFrame) -> DataFrame:
    """Per member ticker: does any listing of the same ticker overlap its membership."""
    lst = listings.select(F.col("ticker").alias("_t"), "listed_from", "listed_to")
    overlap = (
        (F.col("ticker") == F.col("_t"))
        & (F.col("listed_to").isNull() | (F.col("start_date") <= F.col("listed_to")))
        & (F.col("end_date").isNull() | (F.col("listed_from") <= F.col("end_date")))
    )
    marked = intervals.join(lst, overlap, "left").groupBy("ticker").agg(F.max(F.col("_t").isNotNull()).alias("listed"))
    return marked


def ticker_collisions(master: DataFrame) -> DataFrame:
    """Pairs of securities sharing a ticker over overlapping validity. Rows per ticker are few: owners over time."""
    a, b = master.alias("a"), master.alias("b")
    overlap = (
        (F.col("a.ticker") == F.col("b.ticker"))
        & (F.col("a.security_id") < F.col("b.security_id"))
        & (F.col("b.valid_to").isNull() | (F.col("a.valid_from") < F.col("b.valid_to")))
        & (F.col("a.valid_to").isNull() | (F.col("b.valid_from") < F.col("a.valid_to")))
    )
    return a.join(b, overlap).select(
        F.col("a.ticker").alias("ticker"), F.col("a.security_id").alias("first_id"), F.col("b.security_id").alias("second_id")
    )


# ---- ledgers ---------------------------------------------------------------------------------------


def latest_by(events: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Newest row per key; a mergeable maximum, so a hot key shrinks before the shuffle."""
    rest = [x for x in events.columns if x not in keys and x not in order]
    top = events.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return top.select(*keys, *[F.col("r")[x].alias(x) for x in events.columns if x not in keys])


def append_once(new: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows to append: one per key, keys already stored left out."""
    rest = [x for x in new.columns if x not in keys and x not in order]
    first = new.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r"))
    flat = first.select(*keys, *[F.col("r")[x].alias(x) for x in new.columns if x not in keys])
    return flat.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def compare_positions(internal: DataFrame, external: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Whole-book reconciliation on (portfolio, security): MATCHED, MISMATCH or UNKNOWN when a side is missing."""
    both = internal.select("portfolio", "security_id", F.col("quantity").alias("own")).join(
        external.select("portfolio", "security_id", F.col("quantity").alias("other")), ["portfolio", "security_id"], "full_outer"
    )
    return both.withColumn("status", _agreement("own", "other", tolerance))


def _agreement(own: str, other: str, tolerance: float | None = None) -> Column:
    same = F.col(own) == F.col(other) if tolerance is None else F.abs(F.col(own) - F.col(other)) <= tolerance
    missing = F.col(own).isNull() | F.col(other).isNull()
    return F.when(missing, "UNKNOWN").when(same, "MATCHED").otherwise("MISMATCH")


def compare_values(internal: DataFrame, external: DataFrame, key: str, value: str, tolerance: float | None = None) -> DataFrame:
    """Reconciliation of one value per key: cash with a tolerance, statuses without."""
    both = internal.select(key, F.col(value).alias("own")).join(external.select(key, F.col(value).alias("other")), key, "full_outer")
    return both.withColumn("status", _agreement("own", "other", tolerance))


def confirm_cusips(dominant: DataFrame, resolved: DataFrame) -> DataFrame:
    """(ticker, cusip) kept unless resolved to another ticker; a cusip claimed twice is dropped."""
    j = dominant.join(resolved.select("cusip", F.col("ticker").alias("resolved")), "cusip", "left")
    kept = j.filter(F.col("resolved").isNull() | (F.col("resolved") == F.col("ticker")))
    claims = kept.groupBy("cusip").agg(F.count(F.lit(1)).alias("claims"), F.min("ticker").alias("ticker"))
    return claims.filter(F.col("claims") == 1).select("ticker", "cusip")


def seen_symbols(reports: DataFrame, start: Column, end: Column, renames: DataFrame) -> DataFrame:
    """Symbols of earlier reports overlapping the window, and what they were renamed to."""
    used = reports.filter((F.col("window_start") < end) & (start < F.col("window_end"))).select("symbol").distinct()
    new = used.join(renames.select(F.col("old_ticker").alias("symbol"), "new_ticker"), "symbol").select(F.col("new_ticker").alias("symbol"))
    return used.unionByName(new).distinct()


def value_on_or_before(values: DataFrame, key: str, day: str, target: Column) -> DataFrame:
    return values.filter(F.col(day) <= target).groupBy(key).agg(F.max(day).alias(day), F.max_by("value", day).alias("value"))


def with_regime(decisions: DataFrame, regimes: DataFrame) -> DataFrame:
    """Decision with the latest composite regime at its time; the label, or the joined axis states without one."""
    hit = asof_join(decisions, regimes, ["security_id"], "decision_time", "regime_time")
    axes = F.concat_ws("|", "trend", "volatility")
    return hit.withColumn("regime", F.coalesce("label", F.nullif(axes, F.lit(""))))


def with_prediction(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """Missing expected outcome filled from the latest prediction at or before the decision."""
    p = predictions.select("security_id", "prediction_time", "prediction_id", F.col("expected_return").alias("_p"))
    hit = asof_join(records, p, ["security_id"], "decision_time", "prediction_time", tie=["prediction_id"])
    return hit.withColumn("expected_outcome", F.coalesce("expected_outcome", "_p")).drop("_p")


def experience_records(trades: DataFrame, decisions: DataFrame, analyses: DataFrame, counterfactuals: DataFrame) -> DataFrame:
    """Trades with decision, newest analysis and newest counterfactual: one wide training row each."""
    a = latest_by(analyses, ["trade_id"], "seq").select("trade_id", F.col("seq").alias("analysis_seq"), "error")
    c = latest_by(counterfactuals, ["trade_id"], "seq").select("trade_id", F.col("seq").alias("counter_seq"), "alternative")
    d = decisions.select("decision_id", "decision_time", "action", "provenance", "confidence")
    return trades.join(d, "decision_id", "left").join(a, "trade_id", "left").join(c, "trade_id", "left")


def audit_trail(trades: DataFrame, decisions: DataFrame, analyses: DataFrame) -> DataFrame:
    """Trade, decision and the history of analyses. The list per trade is the trade's own few versions."""
    n = analyses.groupBy("trade_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "error"))).alias("analyses"), F.count(F.lit(1)).alias("versions")
    )
    return trades.join(decisions.select("decision_id", "decision_time", "action"), "decision_id", "left").join(n, "trade_id", "left")
