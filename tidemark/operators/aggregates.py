"""Grouped reports: holdings filings, index membership, coverage, contribution, fold summaries, top-k and set reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators.scans import numbered, split_ordered
from tidemark.operators.signals import attach


# ---- holdings filings ------------------------------------------------------------------------------


def winning_submissions(submissions: DataFrame, max_lag_days: int | None = None) -> DataFrame:
    """Per (cik, period) the submission filed last, accession breaking ties."""
    s = submissions.filter(F.col("submission_type").startswith("13F-HR"))
    if max_lag_days is not None:
        s = s.filter(F.datediff("filing_date", "period") <= max_lag_days)
    top = s.groupBy("cik", "period").agg(F.max(F.struct("filing_date", "accession")).alias("r"))
    return top.select("cik", "period", F.col("r.accession").alias("accession"))


def distinct_positions(info: DataFrame) -> DataFrame:
    """Unique by (accession, row key); rows without a key by their whole content."""
    whole = F.concat_ws("|", "cusip", F.col("shares").cast("string"), "shares_type", "put_call")
    key = F.coalesce(F.nullif(F.col("row_key"), F.lit("")), whole)
    return info.withColumn("_key", key).dropDuplicates(["accession", "_key"]).drop("_key")


def is_common_share(shares_type="shares_type", put_call="put_call") -> Column:
    blank_call = F.coalesce(F.trim(F.col(put_call)), F.lit("")) == ""
    kind = F.upper(F.coalesce(F.trim(F.col(shares_type)), F.lit("")))
    return blank_call & kind.isin("", "SH")


def aggregate_holdings(info: DataFrame, winners: DataFrame, cusips: DataFrame) -> DataFrame:
    """Common shares of winning submissions by (security, quarter): total and number of filers.

    A security held by very many filers is merged map-side: first per (security, quarter, cik), then per quarter.
    """
    rows = info.filter(is_common_share()).join(winners, "accession").join(cusips.select("cusip", "security_id"), "cusip")
    per_filer = rows.groupBy("security_id", "period", "cik").agg(F.sum("shares").alias("shares"))
    return per_filer.groupBy("security_id", "period").agg(F.sum("shares").alias("shares"), F.count(F.lit(1)).alias("filers"))


def shares_by_cusip(info: DataFrame) -> DataFrame:
    return info.groupBy("cusip").agg(F.sum("shares").alias("shares"))


def dominant_cusip(totals: DataFrame, valid: Column) -> DataFrame:
    """Valid cusip with most shares per ticker, the smaller cusip on a tie."""
    best = totals.filter(valid).groupBy("ticker").agg(F.max("shares").alias("shares"))
    tied = totals.filter(valid).join(best, ["ticker", "shares"])
    return tied.groupBy("ticker", "shares").agg(F.min("cusip").alias("cusip"))


# ---- membership and coverage -------------------------------------------------------------------------


def reconstruct_intervals(snapshots: DataFrame) -> DataFrame:
    """First and last sight per ticker with censoring and the gaps to the neighbouring snapshots."""
    days = snapshots.select("snapshot").distinct()
    w = Window.orderBy("snapshot")
    order = days.select("snapshot", F.lag("snapshot").over(w).alias("before"), F.lead("snapshot").over(w).alias("after"))
    seen = snapshots.groupBy("ticker").agg(F.min("snapshot").alias("first_seen"), F.max("snapshot").alias("last_seen"))
    a = F.broadcast(order.select(F.col("snapshot").alias("first_seen"), "before"))
    b = F.broadcast(order.select(F.col("snapshot").alias("last_seen"), "after"))
    return seen.join(a, "first_seen").join(b, "last_seen").select(
        "ticker", "first_seen", "last_seen", F.col("before").isNull().alias("left_censored"), F.col("after").isNull().alias("right_censored"),
        F.datediff("first_seen", "before").alias("start_gap"), F.datediff("after", "last_seen").alias("end_gap"),
    )


def coverage_start(intervals: DataFrame) -> DataFrame:
    return intervals.agg(F.min("start_date").alias("start_date"))


def left_censored(intervals: DataFrame) -> DataFrame:
    """Tickers whose earliest start is the start of the whole dataset."""
    first = intervals.groupBy("ticker").agg(F.min("start_date").alias("first"))
    return attach(first, coverage_start(intervals)).filter(F.col("first") == F.col("start_date")).select("ticker")


def listed_from(symbols: DataFrame, intervals: DataFrame) -> DataFrame:
    """Per requested symbol: found, confirmable first date, left the index, digest of its intervals."""
    start = coverage_start(intervals).select(F.col("start_date").alias("data_start"))
    g = intervals.groupBy("ticker").agg(
        F.min("start_date").alias("first"), F.max(F.col("end_date").isNull()).alias("still_in"), F.count(F.lit(1)).alias("intervals")
    )
    j = attach(symbols.join(g, "ticker", "left"), start)
    known = F.when(F.col("first") > F.col("data_start"), F.col("first"))
    digest = F.sha2(F.concat_ws("|", "ticker", F.date_format("first", "yyyy-MM-dd"), F.col("intervals").cast("string")), 256)
    return j.select("ticker", F.col("first").isNotNull().alias("found"), known.alias("listed_from"), (~F.col("still_in")).alias("left_index"), digest.alias("digest"))


def delisted_master(bars: DataFrame) -> DataFrame:
    """Validity of vanished securities from their bars: first day to last day + 1, sources sorted."""
    g = bars.groupBy("security_id").agg(F.min("ts").alias("valid_from"), F.max("ts").alias("last"), F.array_sort(F.collect_set("source")).alias("s"))
    return g.select("security_id", "valid_from", (F.col("last") + F.expr("INTERVAL '1' DAY")).alias("valid_to"), F.array_join("s", ",").alias("sources"), F.lit("DELISTED").alias("status"))


def survivorship(master: DataFrame, collisions: DataFrame) -> DataFrame:
    """Counts by status, reused tickers, collisions and the share of rows with both dates."""
    m = master.agg(
        F.count_if(F.col("status") == "ACTIVE").alias("active"),
        F.count_if(F.col("status") == "DELISTED").alias("delisted"),
        ratio(F.count_if(F.col("valid_to").isNotNull()) * 100, F.count(F.lit(1))).alias("dated_percent"),
    )
    reuse = master.groupBy("ticker").agg(F.countDistinct("security_id").alias("n")).agg(F.count_if(F.col("n") > 1).alias("reused_tickers"))
    out = attach(attach(m, reuse), collisions.agg(F.count(F.lit(1)).alias("collisions")))
    level = F.when(F.col("delisted") == 0, "SURVIVORS_ONLY").when(F.col("dated_percent") < 95, "PARTIAL").otherwise("COVERED")
    return out.withColumn("classification", level)


def universe_rows(symbols: DataFrame, universe: str, fallback: Column) -> DataFrame:
    return symbols.select("security_id", F.lit(universe).alias("universe"), F.coalesce("listed_from", fallback).alias("valid_from"), F.col("listed_to").alias("valid_to"))


def master_rows(symbols: DataFrame, fallback: Column) -> DataFrame:
    status = F.when(F.col("listed_to").isNull(), "ACTIVE").otherwise("DELISTED")
    return symbols.select("security_id", status.alias("status"), F.coalesce("listed_from", fallback).alias("valid_from"), F.col("listed_to").alias("valid_to"))


def catalog_coverage(symbols: DataFrame, bars: DataFrame, start: Column, late_days: int = 30) -> DataFrame:
    g = bars.groupBy("security_id").agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    j = symbols.join(g, "security_id", "left")
    late = F.datediff("first", start) > late_days
    return j.select("security_id", F.coalesce("bars", F.lit(0)).alias("bars"), "first", "last", F.col("first").isNull().alias("missing"), F.coalesce(late, F.lit(False)).alias("late_start"))


def nearest_end_gap(last: Column, ends: Column) -> Column:
    """Days between the last real date and the nearest end date."""
    return F.array_min(F.transform(ends, lambda e: F.abs(F.datediff(last, e))))


def genuine_delisting(gap: Column) -> Column:
    return gap <= 90


def delisting_check(intervals: DataFrame, bars: DataFrame) -> DataFrame:
    """Removed tickers: first and last real bar, gap to the nearest end date, whether the delisting looks genuine."""
    ends = intervals.filter(F.col("end_date").isNotNull()).groupBy(F.col("ticker").alias("security_id")).agg(F.collect_set("end_date").alias("ends"))
    real = bars.filter(F.col("volume") != 0).groupBy("security_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    j = ends.join(real, "security_id", "left").withColumn("gap", nearest_end_gap(F.col("last"), F.col("ends")))
    return j.select("security_id", "first", "last", "gap", genuine_delisting(F.col("gap")).alias("genuine"))


def flag_diagnosis(flags: DataFrame, top: int = 20) -> DataFrame:
    """Securities with most flags; ``top`` is the length of the report."""
    g = flags.groupBy("security_id").agg(F.count(F.lit(1)).alias("flags"))
    return g.orderBy(F.desc("flags"), "security_id").limit(top)


# ---- contribution and portfolio values -----------------------------------------------------------------


def contribution(realized: DataFrame, open_positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Realised + unrealised PnL per security, its share of the total and its rank."""
    r = realized.groupBy("security_id").agg(F.sum("realized_pnl").alias("realized"))
    u = unrealized(open_positions, prices, "security_id")
    both = r.join(u, "security_id", "full_outer").na.fill(0.0, ["realized", "unrealized"]).withColumn("pnl", F.col("realized") + F.col("unrealized"))
    out = attach(both, both.agg(F.sum("pnl").alias("_t")))
    out = out.withColumn("share", ratio("pnl", "_t")).withColumn("_down", -F.col("pnl")).drop("_t")
    order = ["_down", "security_id"]
    return numbered(split_ordered(out, [], order), [], order, "place").drop("_down", "_piece")


def contribution_summary(rows: DataFrame) -> DataFrame:
    """Top-1 and top-3 share of positive PnL and the concentration of absolute PnL."""
    total = rows.agg(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("gain"), F.sum(F.abs("pnl")).alias("gross"))
    j = attach(rows, total)
    pos = F.when(F.col("pnl") > 0, F.col("pnl"))
    return j.agg(
        ratio(F.sum(F.when(F.col("place") <= 1, pos)), F.max("gain")).alias("top1"),
        ratio(F.sum(F.when(F.col("place") <= 3, pos)), F.max("gain")).alias("top3"),
        F.sum(F.pow(ratio(F.abs("pnl"), "gross"), 2)).alias("herfindahl"),
    )


def unrealized(positions: DataFrame, prices: DataFrame, by: str) -> DataFrame:
    """(price - cost) x quantity; positions without a price count 0."""
    j = positions.join(prices.select("security_id", "price"), "security_id", "left")
    gain = F.coalesce((F.col("price") - F.col("average_cost")) * F.col("quantity"), F.lit(0.0))
    return j.groupBy(by).agg(F.sum(gain).alias("unrealized"))


def marked_value(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Portfolio value with missing prices replaced by cost, and how many were missing."""
    j = positions.join(prices.select("security_id", "price"), "security_id", "left")
    worth = F.col("quantity") * F.coalesce("price", "average_cost")
    return j.groupBy("portfolio").agg((F.max("cash") + F.sum(worth)).alias("value"), F.count_if(F.col("price").isNull()).alias("missing"))


def turnover(trades: DataFrame, nav: DataFrame) -> DataFrame:
    t = trades.groupBy("grp").agg(F.sum(F.abs("notional")).alias("traded"))
    return t.join(nav.groupBy("grp").agg(F.avg("value").alias("mean_value")), "grp").withColumn("turnover", ratio("traded", "mean_value"))


def average_rate(rates: DataFrame, start: Column, end: Column) -> DataFrame:
    """Mean yield of the closed window as a fraction; an empty window is an error."""
    inside = rates.filter(F.col("ts").between(start, end))
    mean = F.avg("rate") / 100.0
    return inside.agg(F.when(F.assert_true(F.count(F.lit(1)) > 0, F.lit("no rates in the window")).isNull(), mean).alias("annual_rate"))


def newest_vintages(vintages: DataFrame) -> DataFrame:
    return vintages.filter(F.col("value").isNotNull()).groupBy("series_id", "observation_date").agg(F.max_by("value", "realtime_start").alias("value"))


# ---- fold summaries -----------------------------------------------------------------------------------------


def fold_summary(folds: DataFrame, *by: str) -> DataFrame:
    r = F.col("net_return")
    return folds.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("mean"), F.median(r).alias("median"),
        F.stddev_samp(r).alias("stdev"), F.min(r).alias("low"), F.max(r).alias("high"),
    )


def fold_aggregate(folds: DataFrame) -> DataFrame:
    """Valid folds only: counts, medians, population deviation, best fold, worst drawdown fold, regime counts."""
    f = folds.filter(F.col("valid"))
    per = f.groupBy("candidate", "regime").agg(F.count(F.lit(1)).alias("n"))
    hist = per.groupBy("candidate").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "regime", F.col("n").cast("string")))), "|").alias("regimes"))
    g = f.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("folds"), F.count_if(F.col("net_return") > 0).alias("positive"), F.median("net_return").alias("median"),
        F.stddev_pop("net_return").alias("stdev"), F.max(F.struct("net_return", "fold")).getField("fold").alias("best_fold"),
        F.min(F.struct("drawdown", "fold")).getField("fold").alias("worst_fold"),
    )
    return g.join(hist, "candidate")


def cost_drag(perf: DataFrame) -> DataFrame:
    return perf.withColumn("drag", F.col("gross") - F.col("net"))


def against_benchmark(perf: DataFrame, benchmark: DataFrame) -> DataFrame:
    b = benchmark.select("fold", F.col("net_return").alias("benchmark"))
    return perf.join(b, "fold").withColumn("excess", F.col("net_return") - F.col("benchmark"))


def flatten_reports(reports: DataFrame) -> DataFrame:
    """Report JSON with a map of candidates to one row per candidate."""
    parsed = F.from_json("report", "struct<window:string,candidates:map<string,struct<net:double,folds:int>>>")
    r = reports.select(parsed.alias("r"))
    return r.select(F.col("r.window").alias("window"), F.explode("r.candidates").alias("candidate", "x")).select("window", "candidate", "x.net", "x.folds")


def candidate_names(reports: DataFrame) -> DataFrame:
    return flatten_reports(reports).select("candidate").distinct()


def log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


def strategy_bundle(folds: DataFrame, costs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per candidate the fold summary with cost drag and benchmark excess, and flags for what is present."""
    a = fold_summary(folds, "candidate")
    b = cost_drag(costs).groupBy("candidate").agg(F.avg("drag").alias("drag"))
    c = against_benchmark(folds, benchmark).groupBy("candidate").agg(F.avg("excess").alias("excess"))
    j = a.join(b, "candidate", "left").join(c, "candidate", "left")
    return j.withColumn("has_costs", F.col("drag").isNotNull()).withColumn("has_benchmark", F.col("excess").isNotNull())


def comparison_report(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    b = benchmark.select(F.col("cumulative").alias("b_cumulative"), F.col("cagr").alias("b_cagr"), F.col("max_drawdown").alias("b_drawdown"))
    return attach(strategy, b).withColumn("excess", F.col("cumulative") - F.col("b_cumulative")).withColumn("annual_excess", F.col("cagr") - F.col("b_cagr"))


def side_by_side(reports: DataFrame, names: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics as rows, the named reports as columns."""
    long = reports.unpivot(["grp"], list(metrics), "metric", "value")
    return long.groupBy("metric").pivot("grp", list(names)).agg(F.max("value"))


# ---- top-k ------------------------------------------------------------------------------------------------------


def top_n(scores: DataFrame, n: int) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("score"), "security_id"))
    return scores.filter(F.col("score").isNotNull()).withColumn("place", k).filter(F.col("place") <= n)


def top_n_per_sector(scores: DataFrame, n: int, per_sector: int) -> DataFrame:
    """Best names with at most ``per_sector`` of one sector; names without a sector are exempt.

    The rank inside a sector alone decides who is skipped, so two rankings give the greedy result.
    """
    ranked = scores.filter(F.col("score").isNotNull())
    inside = F.row_number().over(Window.partitionBy("as_of", "sector").orderBy(F.desc("score"), "security_id"))
    kept = ranked.withColumn("s", inside).filter(F.col("sector").isNull() | (F.col("s") <= per_sector))
    return top_n(kept, n)


def new_position_budget(portfolios: DataFrame, margin: float = 0.02) -> DataFrame:
    """Cash per new name: the smaller of spare cash per buy and value per target, never negative."""
    spare = ratio((F.col("cash") + F.col("proceeds")) * (1 - margin), "to_buy")
    cap = ratio(F.col("value") * (1 - margin), "targets")
    return portfolios.withColumn("budget", F.greatest(F.lit(0.0), F.least(spare, cap)))


def order_chunks(plans: DataFrame, max_notional: float, fractional: bool = False) -> DataFrame:
    """Target shares minus held shares, cut into equal-sized chunks under a notional cap plus a rest."""
    raw = ratio(F.col("exposure") * F.col("capital"), "price")
    target = F.floor(raw * 10000) / 10000 if fractional else F.floor(raw).cast("double")
    p = plans.withColumn("delta", target - F.col("held")).withColumn("step", F.greatest(F.floor(F.lit(max_notional) / F.col("price")).cast("double"), F.lit(1.0)))
    n = F.ceil(F.abs("delta") / F.col("step")).cast("int")
    p = p.filter(F.col("delta") != 0).withColumn("chunk", F.explode(F.sequence(F.lit(1), n)))
    left = F.abs("delta") - (F.col("chunk") - 1) * F.col("step")
    return p.withColumn("side", F.when(F.col("delta") > 0, "BUY").otherwise("SELL")).withColumn("quantity", F.least("step", left))


def shard(symbols: DataFrame, key: str, index: int, count: int) -> DataFrame:
    """Every count-th symbol of the sorted list, numbered without a single sorting task."""
    rows = numbered(split_ordered(symbols.select(key).distinct(), [], [key]), [], [key], "no")
    return rows.filter((F.col("no") - 1) % count == index).select(key, "no")


def changed_only(log: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Observations that differ from the one before them."""
    from tidemark.operators.scans import previous

    pieces = split_ordered(log, group, order)
    out = previous(pieces, group, order, F.col(value), "_before")
    return out.filter(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before", "_piece")


def unknown_names(names: DataFrame, known: DataFrame) -> DataFrame:
    return names.join(known, names.columns, "left_anti").distinct()
