"""Market regime of a security at each moment: six axes as state, value and completeness of the data."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import TRADING_DAYS, change, corr_of, fallback_zero, ratio
from tidemark.operators.panel import bar_panel

KEY = ("security_id", "as_of")
# fixed windows and cuts of the axes
TREND_SHORT, TREND_LONG, TREND_BAND = 20, 100, 0.005
VOL_WINDOW, VOL_HISTORY, VOL_LOW, VOL_HIGH, VOL_EXTREME = 20, 100, 0.25, 0.75, 0.95
LIQ_RECENT, LIQ_BASE, LIQ_LOW, LIQ_HIGH = 5, 60, 0.5, 1.5
COR_WINDOW, COR_LOW, COR_HIGH = 60, 0.3, 0.7
STRESS_WINDOW, STRESS_ELEVATED, STRESS_HIGH = 60, -0.10, -0.20
DIST_WINDOW, DIST_DECLINE, DIST_WARN, DIST_HIGH = 25, -0.002, 5, 7
MIN_COMPLETE = 0.75


def price_points(bars: DataFrame) -> DataFrame:
    """(ts, adjusted or raw price, volume) per security."""
    return bars.select("security_id", "ts", fallback_zero("adjusted_close", "close").alias("price"), "volume")


def level_points(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("ts", F.col("level").alias("price"), F.lit(None).cast("double").alias("volume"))


def completeness(available: Column, required: int) -> Column:
    return F.least(F.lit(1.0), available / float(required)) if required > 0 else F.lit(1.0)


def points_on_grid(revisions: DataFrame, grid: Sequence[datetime], days: int = 365) -> DataFrame:
    """Price points per moment; a window holds at most ``days`` rows."""
    return bar_panel(revisions, grid, days, None).select(*KEY, "ts", "rn", "px", "ret", "volume")


def _top(n: int, x: str) -> Column:
    return F.when(F.col("rn") <= n, F.col(x))


# Each axis has up to three parts: columns added to the points by windows, aggregates by key, and the state read off
# them. An axis alone and all of them together are built from the same parts, so that the composite passes once.


def _count() -> Column:
    return F.count(F.lit(1))


def _whole_volume() -> Column:
    return F.count("volume") == _count()


def _trend_sums() -> list[Column]:
    value = F.when(_count() >= TREND_LONG, ratio(F.avg(_top(TREND_SHORT, "px")) - F.avg(_top(TREND_LONG, "px")), F.avg(_top(TREND_LONG, "px"))))
    return [value.alias("trend_value"), completeness(_count(), TREND_LONG).alias("trend_complete")]


def _trend_state(g: DataFrame) -> DataFrame:
    v = F.col("trend_value")
    state = F.when(v.isNull(), "UNKNOWN").when(v > TREND_BAND, "BULL").when(v < -TREND_BAND, "BEAR").otherwise("NEUTRAL")
    return g.withColumn("trend", state)


def trend(points: DataFrame) -> DataFrame:
    return _trend_state(points.groupBy(*KEY).agg(*_trend_sums()))


def rolling_volatility(points: DataFrame) -> DataFrame:
    """Annualised volatility of each ``VOL_WINDOW`` consecutive prices."""
    w = Window.partitionBy(*KEY).orderBy("ts")
    last = w.rowsBetween(-(VOL_WINDOW - 2), 0)
    full = F.row_number().over(w) >= VOL_WINDOW
    vol = F.stddev_samp("ret").over(last) * F.sqrt(F.lit(float(TRADING_DAYS)))
    return points.withColumn("vol", F.when(full, vol))


def _volatility_columns(points: DataFrame) -> DataFrame:
    current = F.max(F.when(F.col("rn") == 1, F.col("vol"))).over(Window.partitionBy(*KEY))
    return rolling_volatility(points).withColumn("current", current).withColumn("h", F.when(F.col("rn") <= VOL_HISTORY, F.col("vol")))


def _volatility_sums() -> list[Column]:
    return [
        F.max("current").alias("volatility_value"),
        completeness(_count(), VOL_WINDOW + VOL_HISTORY - 1).alias("volatility_complete"),
        F.count("vol").alias("_vol_n"),
        ratio(F.count_if(F.col("h") <= F.col("current")), F.count("h")).alias("_vol_rank"),
    ]


def _volatility_state(g: DataFrame) -> DataFrame:
    """Share of the last rolling volatilities at or below the current one, cut into states."""
    usable = (F.col("volatility_complete") >= MIN_COMPLETE) & (F.col("_vol_n") >= 2)
    rank = F.col("_vol_rank")
    state = F.when(~usable, "UNKNOWN").when(rank >= VOL_EXTREME, "EXTREME").when(rank >= VOL_HIGH, "HIGH").when(rank <= VOL_LOW, "LOW").otherwise("NORMAL")
    return g.withColumn("volatility", state).drop("_vol_n", "_vol_rank")


def volatility(points: DataFrame) -> DataFrame:
    return _volatility_state(_volatility_columns(points).groupBy(*KEY).agg(*_volatility_sums()))


def _liquidity_sums() -> list[Column]:
    value = F.when(_whole_volume() & (_count() >= LIQ_BASE), ratio(F.avg(_top(LIQ_RECENT, "volume")), F.avg(_top(LIQ_BASE, "volume"))))
    return [value.alias("liquidity_value"), F.when(_whole_volume(), completeness(_count(), LIQ_BASE)).otherwise(0.0).alias("liquidity_complete")]


def _liquidity_state(g: DataFrame) -> DataFrame:
    v = F.col("liquidity_value")
    return g.withColumn("liquidity", F.when(v.isNull(), "UNKNOWN").when(v < LIQ_LOW, "LOW").when(v > LIQ_HIGH, "HIGH").otherwise("NORMAL"))


def liquidity(points: DataFrame) -> DataFrame:
    return _liquidity_state(points.groupBy(*KEY).agg(*_liquidity_sums()))


def _correlation_columns(points: DataFrame, reference: DataFrame) -> DataFrame:
    """Returns (a, b) between days common with the reference, of the newest of them; ``common`` marks those days."""
    ref = reference.select("as_of", "ts", F.col("px").alias("rpx"), F.lit(True).alias("common"))
    both = points.join(ref, ["as_of", "ts"], "left")
    shared = F.when(F.col("common"), 1)
    newest = Window.partitionBy(*KEY).orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("inside", F.coalesce(F.col("common") & (F.sum(shared).over(newest) <= COR_WINDOW + 1), F.lit(False)))
    before = Window.partitionBy(*KEY).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("inside"), F.struct("px", "rpx")), ignorenulls=True).over(before)
    both = both.withColumn("last", last)
    return both.withColumn("a", F.when(F.col("inside"), change("px", "last.px"))).withColumn("b", F.when(F.col("inside"), change("rpx", "last.rpx")))


def _correlation_sums() -> list[Column]:
    n = F.count("common")
    return [
        F.when(n >= COR_WINDOW + 1, corr_of("a", "b")).alias("correlation_value"),
        F.when(n > 0, completeness(n, COR_WINDOW + 1)).alias("correlation_complete"),
    ]


def _correlation_state(g: DataFrame) -> DataFrame:
    v = F.col("correlation_value")
    state = F.when(v.isNull(), "UNKNOWN").when(v >= COR_HIGH, "HIGH").when(v <= COR_LOW, "LOW").otherwise("NORMAL")
    return g.withColumn("correlation", F.when(F.col("correlation_complete").isNotNull(), state))


def correlation(points: DataFrame, reference: DataFrame) -> DataFrame:
    """Correlation of the last 60 common-day returns with a reference; no row where there is no common day."""
    g = _correlation_columns(points, reference).groupBy(*KEY).agg(*_correlation_sums())
    return _correlation_state(g.where(F.col("correlation_complete").isNotNull()))


def _stress_columns(points: DataFrame) -> DataFrame:
    run = Window.partitionBy(*KEY).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    recent = F.col("rn") <= STRESS_WINDOW
    return points.withColumn("dd", F.when(recent, ratio("px", F.max(F.when(recent, F.col("px"))).over(run)) - 1.0))


def _stress_sums() -> list[Column]:
    return [F.least(F.lit(0.0), F.min("dd")).alias("stress_value"), _count().alias("_stress_n")]


def _stress_state(g: DataFrame) -> DataFrame:
    """Worst drawdown of the last 60 prices combined with the volatility state."""
    g = g.withColumn("stress_complete", completeness(F.col("_stress_n"), STRESS_WINDOW))
    known = (F.col("_stress_n") >= 2) & (F.col("stress_complete") >= MIN_COMPLETE)
    high, v = F.col("volatility").isin("HIGH", "EXTREME"), F.col("stress_value")
    state = F.when(~known, "UNKNOWN").when(high & (v <= STRESS_HIGH), "HIGH").when(high | (v <= STRESS_ELEVATED), "ELEVATED").otherwise("NORMAL")
    return g.withColumn("stress", state).withColumn("stress_value", F.when(known, v)).drop("_stress_n")


def stress(points: DataFrame, volatility_states: DataFrame) -> DataFrame:
    g = _stress_columns(points).groupBy(*KEY).agg(*_stress_sums())
    g = _stress_state(g.join(volatility_states.select(*KEY, "volatility"), list(KEY), "left"))
    return g.select(*KEY, "stress", "stress_value", "stress_complete")


def _distribution_columns(points: DataFrame) -> DataFrame:
    by_time = Window.partitionBy(*KEY).orderBy("ts")
    fell = (F.col("rn") <= DIST_WINDOW) & (F.col("ret") <= DIST_DECLINE) & (F.col("volume") > F.lag("volume").over(by_time))
    return points.withColumn("distributed", fell)


def _distribution_sums() -> list[Column]:
    value = F.when(_whole_volume() & (_count() >= DIST_WINDOW + 1), F.count_if("distributed").cast("double"))
    return [value.alias("distribution_value"), F.when(_whole_volume(), completeness(_count(), DIST_WINDOW + 1)).otherwise(0.0).alias("distribution_complete")]


def _distribution_state(g: DataFrame) -> DataFrame:
    v = F.col("distribution_value")
    return g.withColumn("distribution", F.when(v.isNull(), "UNKNOWN").when(v >= DIST_HIGH, "HIGH").when(v >= DIST_WARN, "ELEVATED").otherwise("NORMAL"))


def distribution_days(points: DataFrame) -> DataFrame:
    """Days of the last 25 with a decline on higher volume."""
    return _distribution_state(_distribution_columns(points).groupBy(*KEY).agg(*_distribution_sums()))


def composite_label(trend_state="trend", vol_state="volatility", stress_state="stress") -> Column:
    t, v = F.col(trend_state), F.col(vol_state)
    named = (
        F.when(v == "LOW", F.concat(t, F.lit("_LOW_VOL"))).when(v.isin("HIGH", "EXTREME"), F.concat(t, F.lit("_HIGH_VOL")))
    )
    return F.when(F.col(stress_state) == "HIGH", "HIGH_STRESS").when(t.isin("BULL", "BEAR"), named)


def composite(revisions: DataFrame, reference: DataFrame, grid: Sequence[datetime]) -> DataFrame:
    """All axes in one row: one pass of windows over the points and one aggregation, beside the join with the reference."""
    points = _correlation_columns(points_on_grid(revisions, grid), points_on_grid(reference, grid))
    points = _distribution_columns(_stress_columns(_volatility_columns(points)))
    out = points.groupBy(*KEY).agg(*_trend_sums(), *_volatility_sums(), *_liquidity_sums(), *_correlation_sums(), *_stress_sums(), *_distribution_sums())
    for state in (_trend_state, _volatility_state, _liquidity_state, _correlation_state, _stress_state, _distribution_state):
        out = state(out)
    return out.withColumn("label", composite_label())
