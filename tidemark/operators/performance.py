"""Performance of value series: a table (grp, ts, value) with at most one row per group and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import DAYS_PER_YEAR, TRADING_DAYS, c, change, ratio, running_log, running_product
from tidemark.operators.scans import previous, running_sum, split_ordered


def _year_root() -> Column:
    return F.sqrt(F.lit(float(TRADING_DAYS)))


def _by_time():
    return Window.partitionBy("grp").orderBy("ts")


def returns(nav: DataFrame) -> DataFrame:
    """value / previous - 1; pairs whose earlier value is 0 are skipped."""
    r = nav.withColumn("ret", change("value", F.lag("value").over(_by_time())))
    return r.filter(F.col("ret").isNotNull())


def with_path(nav: DataFrame) -> DataFrame:
    """Return, running peak and drawdown per row (drawdown only under a positive peak)."""
    w = _by_time()
    peak = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        nav.withColumn("ret", change("value", F.lag("value").over(w)))
        .withColumn("peak", peak)
        .withColumn("dd", F.when(F.col("peak") > 0, (F.col("value") - F.col("peak")) / F.col("peak")))
    )


def max_drawdown() -> Column:
    return F.coalesce(F.least(F.lit(0.0), F.min("dd")), F.lit(0.0))


def volatility0(ret="ret") -> Column:
    return F.coalesce(F.stddev_samp(ret) * _year_root(), F.lit(0.0))


def sharpe(ret="ret", rate: float = 0.0) -> Column:
    excess = c(ret) - F.lit(rate / TRADING_DAYS)
    return F.coalesce(ratio(F.avg(excess), F.stddev_samp(excess)) * _year_root(), F.lit(0.0))


def sortino(ret="ret", rate: float = 0.0) -> Column:
    excess = c(ret) - F.lit(rate / TRADING_DAYS)
    down = F.sqrt(F.avg(F.pow(F.least(F.lit(0.0), excess), 2)))
    return F.when(F.count(excess) >= 2, F.coalesce(ratio(F.avg(excess), down) * _year_root(), F.lit(0.0))).otherwise(0.0)


def cagr(first, last, start, end) -> Column:
    years = F.floor((F.unix_seconds(end) - F.unix_seconds(start)) / 86400) / DAYS_PER_YEAR
    return F.when((years > 0) & (c(first) > 0), F.pow(ratio(last, first), ratio(1.0, years)) - 1.0).otherwise(0.0)


def calmar(cagr_value, drawdown) -> Column:
    return F.coalesce(ratio(cagr_value, F.abs(c(drawdown))), F.lit(0.0))


def ulcer() -> Column:
    return F.coalesce(F.sqrt(F.avg(F.col("dd") * F.col("dd"))), F.lit(0.0))


def value_at_risk(confidence: float = 0.95) -> Column:
    return F.percentile("ret", 1.0 - confidence)


def conditional_value_at_risk(nav: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(grp, var, cvar): mean of the returns at or below the quantile."""
    r = returns(nav)
    var = r.groupBy("grp").agg(value_at_risk(confidence).alias("var"))
    tail = r.join(var, "grp").filter(F.col("ret") <= F.col("var"))
    return tail.groupBy("grp").agg(F.max("var").alias("var"), F.avg("ret").alias("cvar"))


def drawdown_episodes(nav: DataFrame) -> DataFrame:
    """Peak, trough, recovery and depth. A value at or above the peak starts a new island of rows."""
    w = _by_time()
    before = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col("value") >= before)).cast("int")
    island = nav.withColumn("opens", opens).withColumn("island", F.sum("opens").over(w))
    g = island.groupBy("grp", "island").agg(
        F.min("ts").alias("peak_time"),
        F.min_by("value", "ts").alias("peak_value"),
        F.min(F.struct("value", "ts")).alias("low"),
        F.count(F.lit(1)).alias("n"),
    )
    nxt = F.lead("peak_time").over(Window.partitionBy("grp").orderBy("island"))
    days = lambda a, b: F.floor((F.unix_seconds(b) - F.unix_seconds(a)) / 86400)
    return (
        g.withColumn("recovery_time", nxt)
        .filter(F.col("n") > 1)
        .select(
            "grp",
            "peak_time",
            F.col("low.ts").alias("trough_time"),
            "recovery_time",
            F.when(F.col("peak_value") > 0, (F.col("low.value") - F.col("peak_value")) / F.col("peak_value")).otherwise(0.0).alias("depth"),
            days("peak_time", "low.ts").alias("days_to_trough"),
            days("low.ts", "recovery_time").alias("recovery_days"),
        )
    )


def worst_episode(episodes: DataFrame) -> DataFrame:
    rest = [x for x in episodes.columns if x not in ("grp", "depth", "peak_time")]
    top = episodes.groupBy("grp").agg(F.min(F.struct("depth", "peak_time", *rest)).alias("r"))
    return top.select("grp", "r.*")


def runs(trades: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Runs of wins (pnl > 0) and of the rest as (group, run, won, n), ``run`` rising in order.

    A group of any size is scanned in pieces.
    """
    won = trades.select(*group, *order, (F.col("realized_pnl") > 0).alias("won"))
    pieces = split_ordered(won, group, order)
    turned = previous(pieces, group, order, F.col("won"), "was")
    turned = turned.withColumn("turn", F.when(F.col("was") == F.col("won"), 0).otherwise(1))
    return running_sum(turned, group, order, F.col("turn"), "run").groupBy(*group, "run", "won").agg(F.count(F.lit(1)).alias("n"))


def _longest(won: bool) -> Column:
    return F.coalesce(F.max(F.when(F.col("won") == won, F.col("n"))), F.lit(0).cast("bigint"))


def streaks(trades: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Longest runs of wins and of the rest per group."""
    return runs(trades, group, order).groupBy(*group).agg(_longest(True).alias("max_wins"), _longest(False).alias("max_losses"))


def streak_summary(trades: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What a later stretch of trades needs to go on: first and last run, number of runs, longest runs."""
    ends = F.struct("run", "won", "n")
    return runs(trades, group, order).groupBy(*group).agg(
        F.min(ends).alias("head"), F.max(ends).alias("tail"), F.count(F.lit(1)).alias("runs"), _longest(True).alias("max_wins"), _longest(False).alias("max_losses")
    ).select(
        *group, F.col("head.won").alias("head_won"), F.col("head.n").alias("head_n"), F.col("tail.won").alias("tail_won"), F.col("tail.n").alias("tail_n"), "runs", "max_wins", "max_losses"
    )


SUMMARY = ("head_won", "head_n", "tail_won", "tail_n", "runs", "max_wins", "max_losses")


def _in_a_row(a: Column, b: Column) -> Column:
    """Summary of two stretches in a row: the run across the seam is joined when both sides agree."""
    seam, across = a["tail_won"] == b["head_won"], a["tail_n"] + b["head_n"]
    joined = lambda won: F.when(seam & (a["tail_won"] == won), across).otherwise(0)
    return F.struct(
        a["head_won"].alias("head_won"),
        F.when(seam & (a["runs"] == 1), across).otherwise(a["head_n"]).alias("head_n"),
        b["tail_won"].alias("tail_won"),
        F.when(seam & (b["runs"] == 1), across).otherwise(b["tail_n"]).alias("tail_n"),
        (a["runs"] + b["runs"] - F.when(seam, 1).otherwise(0)).alias("runs"),
        F.greatest(a["max_wins"], b["max_wins"], joined(True)).alias("max_wins"),
        F.greatest(a["max_losses"], b["max_losses"], joined(False)).alias("max_losses"),
    )


def chain_streaks(parts: DataFrame, group: Sequence[str], at: str) -> DataFrame:
    """One summary per group of the stretches in ``parts``, in the order of ``at``; a group has as many rows as there are stretches."""
    listed = parts.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(at, F.struct(*SUMMARY).alias("s")))).alias("p"))
    stretches = F.transform("p", lambda x: x["s"])
    whole = F.aggregate(F.slice(stretches, 2, F.size("p")), stretches[0], _in_a_row)
    return listed.select(*group, whole.alias("s")).select(*group, "s.*")


def relative_metrics(nav: DataFrame, benchmark: DataFrame, rate: float = 0.0) -> DataFrame:
    """Beta, tracking error, information ratio and alpha on the days both series hold."""
    b = benchmark.select("ts", F.col("value").alias("bench"))
    w = _by_time()
    p0, b0 = F.lag("value").over(w), F.lag("bench").over(w)
    pairs = nav.join(b, "ts").withColumn("rp", F.when((p0 > 0) & (b0 > 0), F.col("value") / p0 - 1.0))
    pairs = pairs.withColumn("rb", F.when(F.col("rp").isNotNull(), F.col("bench") / b0 - 1.0)).withColumn("act", F.col("rp") - F.col("rb"))
    period_rate = F.lit(rate / TRADING_DAYS)
    beta = F.when(F.var_samp("rb") > 0, ratio(F.covar_samp("rp", "rb"), F.var_samp("rb")))
    error = F.stddev_samp("act") * _year_root()
    return pairs.groupBy("grp").agg(
        beta.alias("beta"),
        error.alias("tracking_error"),
        F.when(error > 0, F.avg("act") * TRADING_DAYS / error).alias("information_ratio"),
        (((F.avg("rp") - period_rate) - beta * (F.avg("rb") - period_rate)) * TRADING_DAYS).alias("alpha"),
    )


def performance_report(nav: DataFrame, rate: float = 0.0) -> DataFrame:
    """All single-series metrics in one aggregation, worst episode and tail mean joined per group."""
    g = with_path(nav).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("value", "ts").alias("first"),
        F.max_by("value", "ts").alias("last"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        volatility0().alias("volatility"),
        sharpe("ret", rate).alias("sharpe"),
        sortino("ret", rate).alias("sortino"),
        max_drawdown().alias("max_drawdown"),
        ulcer().alias("ulcer"),
    )
    g = g.withColumn("cumulative", F.coalesce(change("last", "first"), F.lit(0.0))).withColumn("cagr", cagr("first", "last", "start", "end"))
    g = g.withColumn("calmar", calmar("cagr", "max_drawdown"))
    worst = worst_episode(drawdown_episodes(nav)).select("grp", "days_to_trough", "recovery_days", F.col("recovery_time").isNull().alias("underwater"))
    return g.join(conditional_value_at_risk(nav), "grp", "left").join(worst, "grp", "left")


def session_report(nav: DataFrame, min_periods: int = 5) -> DataFrame:
    """The same family with NULL and a reason where a metric is undefined."""
    r = performance_report(nav)
    few = F.lit("insufficient_data")
    enough = F.col("n") >= min_periods
    reasons = {
        "volatility": F.when(~enough, few),
        "sharpe": F.when(~enough, few).when(F.col("volatility") == 0, "zero_volatility"),
        "sortino": F.when(~enough, few).when(F.col("sortino") == 0, "zero_downside_deviation"),
        "calmar": F.when(F.col("n") < 2, few).when(F.col("max_drawdown") == 0, "zero_drawdown"),
    }
    out = r
    for name, why in reasons.items():
        out = out.withColumn(f"{name}_reason", why)
    for name in reasons:
        out = out.withColumn(name, F.when(F.col(f"{name}_reason").isNull(), F.col(name)))
    return out


def benchmark_nav(levels: DataFrame, capital: float, fee: float, half_spread: float) -> DataFrame:
    """Buy and hold: units bought at the ask less a fee, valued daily; one summary row."""
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    units = (F.lit(capital) - fee) / (F.first("level").over(w) * (1 + half_spread))
    series = levels.withColumn("units", units).withColumn("value", F.col("units") * F.col("level"))
    path = with_path(series.withColumn("grp", F.lit("benchmark")))
    g = path.groupBy("grp").agg(
        F.max_by("level", "ts").alias("last"), F.max("units").alias("units"), F.min("ts").alias("start"), F.max("ts").alias("end"), max_drawdown().alias("max_drawdown")
    )
    final = F.col("units") * F.col("last") * (1 - half_spread) - fee
    return g.withColumn("final_value", final).select(
        "grp", "start", "end", "final_value", change("final_value", F.lit(capital)).alias("cumulative"),
        cagr(F.lit(capital), "final_value", "start", "end").alias("cagr"), "max_drawdown",
    )


def total_return_levels(bars: DataFrame, actions: DataFrame, base: float = 100.0) -> DataFrame:
    """Level chained by (close * split + dividend) / previous close; same-day actions multiply and add.

    The level is known when every bar and action up to it is known. Its logarithm is summed up by itself: with many actions
    the level leaves the range of a double.
    """
    from tidemark.operators.holdings import SPLIT_TYPES, parse_ratio

    when = F.date_trunc("day", F.coalesce("effective_time", "event_time"))
    kind = F.col("action_type")
    split = F.when(kind.isin(*SPLIT_TYPES), parse_ratio("ratio_text"))
    per_day = actions.groupBy("security_id", when.alias("ts")).agg(
        F.exp(F.sum(F.ln(F.when(split > 0, split)))).alias("split"),
        F.sum(F.when(~kind.isin(*SPLIT_TYPES), F.col("amount"))).alias("dividend"),
        F.max("available_time").alias("action_known"),
    )
    w = Window.partitionBy("security_id").orderBy("ts")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    b = bars.join(per_day, ["security_id", "ts"], "left").withColumn("prev", F.lag("close").over(w))
    step = (F.col("close") * F.coalesce("split", F.lit(1.0)) + F.coalesce("dividend", F.lit(0.0))) / F.col("prev")
    b = b.withColumn("step", F.when(F.col("prev") > 0, step).otherwise(1.0))
    return b.select(
        "security_id",
        "ts",
        (F.lit(base) * running_product("step", run)).alias("level"),
        (F.ln(F.lit(base)) + running_log("step", run)).alias("log_level"),
        F.max(F.greatest("available_time", F.coalesce("action_known", "available_time"))).over(run).alias("available_time"),
    )


def month_ends(bars: DataFrame, price="px_null") -> DataFrame:
    """Last positive price of each month."""
    m = F.date_trunc("month", "ts")
    return bars.filter(F.col(price) > 0).groupBy("security_id", m.alias("month")).agg(F.max_by(price, "ts").alias("price"))


def sma_exposure(bars: DataFrame, months: int = 10) -> DataFrame:
    """Exposure for the following month: 1 above the mean of the last month ends, 0 below, NULL while too few."""
    w = Window.partitionBy("security_id").orderBy("month")
    last = w.rowsBetween(-(months - 1), 0)
    m = month_ends(bars).withColumn("n", F.count(F.lit(1)).over(last)).withColumn("mean", F.avg("price").over(last))
    return m.select("security_id", "month", F.when(F.col("n") == months, (F.col("price") > F.col("mean")).cast("double")).alias("exposure"))


def vol_target_exposure(bars: DataFrame, target: float = 0.10, days: int = 21) -> DataFrame:
    """min(1, target / trailing volatility) per day."""
    w = Window.partitionBy("security_id").orderBy("ts")
    r = bars.filter(F.col("px_null") > 0).withColumn("ret", change("px_null", F.lag("px_null").over(w)))
    last = w.rowsBetween(-(days - 1), 0)
    vol = F.stddev_samp("ret").over(last) * _year_root()
    r = r.withColumn("n", F.count("ret").over(last)).withColumn("vol", vol)
    return r.select(
        "security_id", "ts", F.when(F.col("n") == days, F.when(F.col("vol") <= 0, 1.0).otherwise(F.least(F.lit(1.0), ratio(target, "vol")))).alias("exposure")
    )


def walk_forward(ranges: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """Rolling train/test windows by months; each start clamps the day of the one before it."""
    steps = F.greatest(F.ceil(F.months_between("end", "start") / step).cast("int") + 1, F.lit(1))
    chain = F.aggregate(
        F.sequence(F.lit(1), steps),
        F.array(F.col("start")),
        lambda acc, _i: F.concat(acc, F.array((F.add_months(F.element_at(acc, -1), step)).cast("timestamp"))),
    )
    w = ranges.select("grp", "start", "end", F.explode(chain).alias("train_start"))
    w = w.withColumn("train_end", F.add_months("train_start", train).cast("timestamp"))
    w = w.withColumn("test_end", F.add_months("train_end", test).cast("timestamp"))
    return w.filter(F.col("test_end") <= F.col("end")).select("grp", "train_start", "train_end", F.col("train_end").alias("test_start"), "test_end")


def fixed_windows(ranges: DataFrame, train_days: int, test_days: int, step_days: int) -> DataFrame:
    """Rolling windows by fixed durations."""
    last = F.col("end") - F.make_dt_interval(F.lit(train_days + test_days))
    starts = F.when(last >= F.col("start"), F.sequence(F.col("start"), last, F.make_dt_interval(F.lit(step_days))))
    w = ranges.select("grp", F.explode(starts).alias("train_start"))
    end = F.col("train_start") + F.make_dt_interval(F.lit(train_days))
    return w.select("grp", "train_start", end.alias("train_end"), (end + F.make_dt_interval(F.lit(test_days))).alias("test_end"))


def chronological_split(ranges: DataFrame, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Train, validation and test bounds of a time range."""
    span = F.unix_micros("end") - F.unix_micros("start")

    def cut(share):
        return F.timestamp_micros((F.unix_micros("start") + F.round(span * share)).cast("bigint"))

    return ranges.select("grp", F.col("start").alias("train_start"), cut(train).alias("train_end"), cut(train + validation).alias("validation_end"), F.col("end").alias("test_end"))
