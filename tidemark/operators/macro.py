"""Macro signals on vintage data: true, false or NULL when they cannot be computed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import nearest_rank, ratio

# fixed limits of the signals
DAILY, WEEKLY, MONTHLY = 14, 30, 100
CHANGE_DAYS = 91
EXPOSURE_BY_COUNT = (1.0, 1.0, 0.75, 0.5)
SINGLE_EXPOSURE = 0.5


def fresh(observed, as_of, days: int) -> Column:
    return F.datediff(as_of, observed) <= days


def _window(series: DataFrame, series_id: str, days: int) -> DataFrame:
    """Known values of one series in the days before each moment: (as_of, observation_date, value)."""
    since = F.date_sub(F.to_date("as_of"), days)
    return series.filter((F.col("series_id") == series_id) & (F.to_date("observation_date") >= since) & (F.col("observation_date") <= F.col("as_of")))


def _last(x: str = "value") -> Column:
    return F.max_by(x, "observation_date")


def _flag(moments: DataFrame, found: DataFrame, name: str) -> DataFrame:
    return moments.join(found.select("as_of", F.col("flag").alias(name)), "as_of", "left")


def high_percentile(series: DataFrame, series_id: str, q: float = 0.8, days: int = 365, least: int = 200, stale: int = DAILY) -> DataFrame:
    """Last value above the nearest-rank percentile of the year; a year of one series is a bounded list."""
    g = _window(series, series_id, days).groupBy("as_of").agg(
        F.collect_list("value").alias("v"), F.max("observation_date").alias("d"), _last().alias("last")
    )
    ok = (F.size("v") >= least) & fresh(F.col("d"), F.col("as_of"), stale)
    return g.select("as_of", F.when(ok, F.col("last") > nearest_rank(F.col("v"), q)).alias("flag"))


def level_sign(series: DataFrame, series_id: str, above: bool, stale: int) -> DataFrame:
    """Last fresh value above (or below) zero."""
    last = _window(series, series_id, stale).groupBy("as_of").agg(_last().alias("v"))
    return last.select("as_of", ((F.col("v") > 0) if above else (F.col("v") < 0)).alias("flag"))


def change_above(series: DataFrame, series_id: str, threshold: float, relative: bool, stale: int = DAILY, lookback: int = CHANGE_DAYS) -> DataFrame:
    """Change over the lookback above the threshold; the earlier value may be ``stale`` days off its target."""
    w = _window(series, series_id, lookback + 2 * stale)
    last = w.groupBy("as_of").agg(F.max("observation_date").alias("d"), _last().alias("latest"))
    last = last.withColumn("target", F.date_sub(F.to_date("d"), lookback))
    prior = w.join(last, "as_of").filter(F.to_date("observation_date") <= F.col("target")).groupBy("as_of").agg(
        F.max("observation_date").alias("pd"), _last().alias("prior")
    )
    j = last.join(prior, "as_of", "left")
    ok = fresh(F.col("d"), F.col("as_of"), stale) & (F.datediff("target", "pd") <= stale)
    moved = ratio("latest", "prior") - 1.0 if relative else F.col("latest") - F.col("prior")
    if relative:
        ok = ok & (F.col("prior") > 0)
    return j.select("as_of", F.when(ok, moved > threshold).alias("flag"))


def sahm(series: DataFrame, series_id: str, threshold: float = 0.5, stale: int = MONTHLY) -> DataFrame:
    """3-month mean (two of three months needed) minus the low of the twelve before it."""
    w = _window(series, series_id, 20 * 31)
    month = (F.year("observation_date") * 12 + F.month("observation_date")).alias("m")
    monthly = w.groupBy("as_of", month).agg(_last().alias("v"), F.max("observation_date").alias("d"))
    last = monthly.groupBy("as_of").agg(F.max("m").alias("last"), F.max("d").alias("d"))
    spread = monthly.select("as_of", "v", F.explode(F.sequence(F.col("m"), F.col("m") + 2)).alias("m"))
    mean = spread.groupBy("as_of", "m").agg(F.avg("v").alias("mean"), F.count("v").alias("n")).join(last, "as_of")
    inside = mean.filter((F.col("m") <= F.col("last")) & (F.col("m") >= F.col("last") - 12))
    g = inside.groupBy("as_of").agg(
        F.count_if(F.col("n") >= 2).alias("full"),
        F.max(F.when(F.col("m") == F.col("last"), F.col("mean"))).alias("now"),
        F.min(F.when(F.col("m") < F.col("last"), F.col("mean"))).alias("low"),
        F.max("d").alias("d"),
    )
    ok = (F.col("full") == 13) & fresh(F.col("d"), F.col("as_of"), stale)
    gap = F.when(ok, F.col("now") - F.col("low"))
    return g.select("as_of", gap.alias("gap"), (gap >= threshold).alias("flag"))


def claims_rise(series: DataFrame, series_id: str, rise: float = 0.2, weeks: int = 52, average: int = 4, stale: int = WEEKLY) -> DataFrame:
    """Mean of the last weeks over the lowest such mean of a year."""
    total = weeks + average
    w = _window(series, series_id, (total + 4) * 7)
    by_date = Window.partitionBy("as_of").orderBy("observation_date")
    newest = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("observation_date")))
    last = by_date.rowsBetween(-(average - 1), 0)
    m = w.withColumn("k", newest).filter(F.col("k") <= total)
    m = m.withColumn("mean", F.when(F.count("value").over(last) == average, F.avg("value").over(last)))
    g = m.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("observation_date").alias("d"),
        F.max(F.when(F.col("k") == 1, F.col("mean"))).alias("now"),
        F.min(F.when(F.col("k") <= weeks, F.col("mean"))).alias("low"),
    )
    ok = (F.col("n") >= total) & fresh(F.col("d"), F.col("as_of"), stale) & (F.col("low") > 0)
    return g.select("as_of", F.when(ok, ratio("now", "low") - 1.0 > rise).alias("flag"))


def flight_to(gold: DataFrame, equity: DataFrame, days: int = 63, stale: int = DAILY) -> DataFrame:
    """Relative strength of two price panels over their last common days."""
    a = gold.filter(F.col("px_null") > 0).select("as_of", "ts", F.col("px_null").alias("a"))
    b = equity.filter(F.col("px_null") > 0).select("as_of", "ts", F.col("px_null").alias("b"))
    k = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("ts")))
    both = a.join(b, ["as_of", "ts"]).withColumn("k", k).filter(F.col("k") <= days + 1)

    def at(x, rank):
        return F.max(F.when(F.col("k") == rank, F.col(x)))

    g = both.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("d"), (at("a", 1) / at("a", days + 1) > at("b", 1) / at("b", days + 1)).alias("up")
    )
    return g.select("as_of", F.when((F.col("n") == days + 1) & fresh(F.col("d"), F.col("as_of"), stale), F.col("up")).alias("flag"))


def snapshot(moments: DataFrame, signals: dict[str, DataFrame]) -> DataFrame:
    """One row per moment, a three-valued column per signal."""
    return reduce(lambda acc, kv: _flag(acc, kv[1], kv[0]), signals.items(), moments)


def active_count(names) -> Column:
    return sum((F.coalesce(F.col(n), F.lit(False)).cast("int") for n in names), F.lit(0))


def exposure(names) -> Column:
    """1 without signals; a single signal halves; several use the count table."""
    if not names:
        return F.lit(1.0)
    active = active_count(names)
    if len(names) == 1:
        return F.when(active > 0, SINGLE_EXPOSURE).otherwise(1.0)
    table = F.array(*[F.lit(x) for x in EXPOSURE_BY_COUNT])
    return F.element_at(table, F.least(active, F.lit(len(EXPOSURE_BY_COUNT) - 1)) + 1)


def passes(drawdown, sharpe, cagr, base_drawdown, base_sharpe, base_cagr) -> Column:
    """Drawdown at least 15 points shallower, Sharpe not lower, CAGR at most 1.5 points given up."""
    return (drawdown - base_drawdown >= 0.15) & (sharpe >= base_sharpe) & (base_cagr - cagr <= 0.015)
