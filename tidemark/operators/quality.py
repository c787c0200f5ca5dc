"""Quality checks. Each returns issue rows: check_name, severity, security_id, ts, message."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join, calendar_join, next_join
from tidemark.operators.holdings import SPLIT_TYPES, parse_ratio
from tidemark.operators.scans import earlier_max, split_ordered
from tidemark.session import ensure_checkpoint_dir

PRICES = ("open", "high", "low", "close", "volume", "adjusted_close", "adjusted_high", "adjusted_low")
# fixed limits of the checks
EXTREME_MOVE = 0.5
ORDINARY_GAP_DAYS = 4
SPLIT_TOLERANCE = 0.5

SEVERITY_RANK = {"WARNING": 1, "ERROR": 2, "CRITICAL": 3}


def _text(*parts) -> Column:
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def issues(rows: DataFrame, check: str, severity, message: Column, ts: str = "ts") -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(
        F.lit(check).alias("check_name"), level.alias("severity"), "security_id", F.col(ts).cast("timestamp").alias("ts"), message.alias("message")
    )


def _several(column: str) -> Column:
    """Whether a group has different values; two extremes merge on the map side, a distinct count shuffles every value."""
    return F.coalesce(F.min(column) < F.max(column), F.lit(False))


def duplicates(bars: DataFrame) -> DataFrame:
    """Same (security, time, source) more than once: revisions warn, identical versions are errors."""
    g = bars.groupBy("security_id", "ts", "source").agg(
        F.count(F.lit(1)).alias("n"), _several("data_version").alias("several")
    )
    level = F.when(F.col("several"), "WARNING").otherwise("ERROR")
    kinds = F.when(F.col("several"), "several versions").otherwise("one version")
    return issues(g.filter(F.col("n") > 1), "duplicate_records", level, _text(F.col("n"), "records,", kinds))


def out_of_order(bars: DataFrame, sequence: str = "seq") -> DataFrame:
    """Rows earlier than the latest time seen before them in input order. The order is split over tasks."""
    order = [sequence, "ts"]
    pieces = split_ordered(bars.select("security_id", *order), ["security_id"], order)
    seen = earlier_max(pieces, ["security_id"], order, F.col("ts"), "latest")
    return issues(seen.filter(F.col("ts") < F.col("latest")), "timestamp_monotonicity", "WARNING", _text("after", F.col("latest")))


def _finite_fields() -> Column:
    bad = F.lit(False)
    for p in PRICES:
        v = F.col(p).cast("double")
        bad = bad | F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))
    return ~bad


Rule = tuple[str, str, Column, Column]  # check name, severity, when it fires, message


def flagged(rows: DataFrame, *rules: Rule, ts: str = "ts") -> DataFrame:
    """Issue rows of all rules in one pass over ``rows``."""
    fired = [F.when(fires, F.struct(F.lit(name).alias("check_name"), F.lit(level).alias("severity"), message.alias("message"))) for name, level, fires, message in rules]
    found = rows.select("security_id", F.col(ts).cast("timestamp").alias("ts"), F.inline(F.array_compact(F.array(*fired))))
    return found.select("check_name", "severity", "security_id", "ts", "message")


def _non_finite() -> Rule:
    return "non_finite_value", "CRITICAL", ~_finite_fields(), F.lit("NaN or infinite field")


def _ohlc() -> Rule:
    """NaN fails every comparison, while Spark orders it above all numbers: not-finite rows fail outright."""
    h, lo, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
    nan = F.isnan(h) | F.isnan(lo) | F.isnan(o) | F.isnan(c)
    valid = (h >= F.greatest(o, c)) & (lo <= F.least(o, c)) & (h >= lo) & ~nan
    return "ohlc_consistency", "ERROR", ~valid, _text("open", o, "high", h, "low", lo, "close", c)


def _bad_price() -> Rule:
    return "negative_or_zero_price", "ERROR", F.least("open", "high", "low", "close") <= 0, _text("close", F.col("close"))


def _negative_volume() -> Rule:
    return "negative_volume", "ERROR", F.col("volume") < 0, _text("volume", F.col("volume"))


def _future_dated(now: Column) -> Rule:
    return "future_dated", "ERROR", F.col("available_time") > now, _text("available", F.col("available_time"))


def _inversion() -> Rule:
    return "ingestion_precedes_availability", "ERROR", F.col("ingestion_time") < F.col("available_time"), F.lit("ingested before available")


def _extreme_move() -> Rule:
    move = F.abs(F.col("close") - F.col("prev")) / F.when(F.col("prev") > 0, F.col("prev"))
    return "impossible_price_movement", "WARNING", move > EXTREME_MOVE, _text("from", F.col("prev"), "to", F.col("close"))


def _gap(days: int) -> Rule:
    return "missing_timestamp_gaps", "WARNING", F.col("gap") > days, _text(F.col("gap"), "day gap")


def _stale(now: Column, days: int) -> Rule:
    late = F.col("newest") & (F.col("ts") + F.make_dt_interval(F.lit(days)) < now)
    return "stale_data", "WARNING", late, F.lit("no recent bar")


def in_sequence(bars: DataFrame) -> DataFrame:
    """``bars``, one row per security and day, with the close before, the days since, and whether it is the newest."""
    w = Window.partitionBy("security_id").orderBy("ts")
    gap = F.floor((F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w))) / 86400)
    return bars.withColumn("prev", F.lag("close").over(w)).withColumn("gap", gap).withColumn("newest", F.lead("ts").over(w).isNull())


def non_finite(bars: DataFrame) -> DataFrame:
    return flagged(bars, _non_finite())


def ohlc(bars: DataFrame) -> DataFrame:
    return flagged(bars, _ohlc())


def bad_price(bars: DataFrame) -> DataFrame:
    return flagged(bars, _bad_price())


def negative_volume(bars: DataFrame) -> DataFrame:
    return flagged(bars, _negative_volume())


def extreme_moves(bars: DataFrame) -> DataFrame:
    """Close-to-close moves above the limit; ``bars`` holds one row per security and day."""
    return flagged(in_sequence(bars), _extreme_move())


def unknown_symbols(bars: DataFrame, known: DataFrame) -> DataFrame:
    return issues(bars.join(known.select("security_id"), "security_id", "left_anti"), "symbol_mismatch", "ERROR", F.lit("unknown security"))


def future_dated(bars: DataFrame, now: Column) -> DataFrame:
    return flagged(bars, _future_dated(now))


def stale(bars: DataFrame, now: Column, days: int = 5) -> DataFrame:
    return flagged(in_sequence(bars), _stale(now, days))


def ingestion_inversions(bars: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    out = flagged(bars, _inversion())
    return out if actions is None else out.unionByName(flagged(actions, _inversion(), ts="event_time"))


def gaps(bars: DataFrame, days: int = ORDINARY_GAP_DAYS) -> DataFrame:
    return flagged(in_sequence(bars), _gap(days))


def thin_coverage(bars: DataFrame, minimum: DataFrame) -> DataFrame:
    """minimum: (security_id, min_bars). Securities without any bar count as 0."""
    n = bars.groupBy("security_id").agg(F.count(F.lit(1)).alias("n"))
    short = minimum.join(n, "security_id", "left").filter(F.coalesce("n", F.lit(0)) < F.col("min_bars"))
    return issues(short.withColumn("ts", F.lit(None).cast("timestamp")), "insufficient_coverage", "WARNING", _text("bars", F.coalesce("n", F.lit(0))))


def _effective(actions: DataFrame) -> DataFrame:
    return actions.withColumn("effective", F.coalesce("effective_time", "event_time")).filter(F.col("effective").isNotNull())


def split_mismatch(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Registered ratio against last close before and first close at or after the split."""
    ratio_of = parse_ratio("ratio_text")
    a = _effective(actions.filter(F.col("action_type").isin(*SPLIT_TYPES))).withColumn("split_ratio", ratio_of)
    a = a.filter(F.col("split_ratio").isNotNull()).select("security_id", "record_id", "effective", "split_ratio")
    closes = bars.select("security_id", "ts", "close")
    before = asof_join(a, closes.withColumnRenamed("close", "close_before"), ["security_id"], "effective", "ts", strict=True).drop("ts")
    both = next_join(before, closes.withColumnRenamed("close", "close_after"), ["security_id"], "effective", "ts")
    seen = F.col("close_before") / F.col("close_after")
    off = F.abs(seen - F.col("split_ratio")) / F.col("split_ratio") > SPLIT_TOLERANCE
    usable = both.filter((F.col("close_before") > 0) & (F.col("close_after") > 0)).filter(off)
    return issues(usable, "split_consistency", "WARNING", _text("ratio", F.col("split_ratio")), "effective")


def dividend_too_large(bars: DataFrame, actions: DataFrame, kind: str = "CASH_DIVIDEND") -> DataFrame:
    """Dividend above the last close at or before it, or above the first close when none is before."""
    a = _effective(actions.filter((F.col("action_type") == kind) & F.col("amount").isNotNull()))
    a = a.select("security_id", "record_id", "effective", "amount")
    first = bars.groupBy("security_id").agg(F.min_by("close", "ts").alias("first_close"))
    near = asof_join(a, bars.select("security_id", "ts", "close"), ["security_id"], "effective", "ts").drop("ts")
    price = F.coalesce("close", "first_close")
    bad = near.join(first, "security_id").filter((price > 0) & (F.col("amount") > price))
    return issues(bad, "dividend_consistency", "ERROR", _text("amount", F.col("amount")), "effective")


def run_checks(revisions: DataFrame, bars: DataFrame, actions: DataFrame, known: DataFrame, now: Column, minimum: DataFrame) -> DataFrame:
    """All checks in one table of issues. The bars, one row per security and day, are written once for the checks that read them."""
    ensure_checkpoint_dir(bars.sparkSession)
    bars = bars.checkpoint()
    parts = [
        duplicates(revisions),
        out_of_order(revisions),
        flagged(revisions, _non_finite(), _ohlc(), _bad_price(), _negative_volume(), _inversion(), _future_dated(now)),
        unknown_symbols(revisions, known),
        flagged(actions, _inversion(), ts="event_time"),
        flagged(in_sequence(bars), _extreme_move(), _gap(ORDINARY_GAP_DAYS), _stale(now, 5)),
        thin_coverage(bars, minimum),
        split_mismatch(bars, actions),
        dividend_too_large(bars, actions),
    ]
    return reduce(DataFrame.unionByName, parts)


def run_status(found: DataFrame, *group: str) -> DataFrame:
    """CRITICAL_FAILURE, FAILED, PASSED_WITH_WARNINGS or PASSED from the worst severity."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[F.col("severity")]
    names = F.array(*[F.lit(x) for x in ("PASSED", "PASSED_WITH_WARNINGS", "FAILED", "CRITICAL_FAILURE")])
    worst = F.coalesce(F.max(rank), F.lit(0))
    return found.groupBy(*group).agg(F.element_at(names, worst + 1).alias("status"), F.count(F.lit(1)).alias("issues"))


def new_flags(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Issues to append: both keys present and (security, time, check) not stored yet."""
    key = ["security_id", "ts", "check_name"]
    usable = found.filter(F.col("security_id").isNotNull() & F.col("ts").isNotNull())
    once = usable.groupBy(*key).agg(F.min("severity").alias("severity"))
    return once.join(stored.select(*key), key, "left_anti")


def repair_inversions(bars: DataFrame, suffix: str = "-r1") -> DataFrame:
    """Corrected copies of rows ingested before they were available."""
    bad = bars.filter(F.col("ingestion_time") < F.col("available_time"))
    return bad.withColumn("ingestion_time", F.greatest("ingestion_time", "available_time")).withColumn(
        "data_version", F.concat("data_version", F.lit(suffix))
    )


def repair_action_times(actions: DataFrame) -> DataFrame:
    """available_time pulled back to effective + 20 h where it is later."""
    known = F.coalesce("effective_time", "event_time") + F.expr("INTERVAL '20' HOUR")
    return actions.withColumn("available_time", F.when(F.col("available_time") > known, known).otherwise(F.col("available_time")))


# ---- audits of order, fill and position tables ----------------------------------------------------


def fill_audit(fills: DataFrame) -> DataFrame:
    """Duplicate ids, fills not after their decision, two data versions at one (security, time)."""
    dup = fills.groupBy("order_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(
        F.lit("duplicate_fill").alias("problem"), F.col("order_id").cast("string").alias("subject")
    )
    early = fills.filter(F.col("fill_time") <= F.col("decision_time")).select(
        F.lit("fill_not_after_decision").alias("problem"), F.col("order_id").cast("string").alias("subject")
    )
    mixed = (
        fills.groupBy("security_id", "fill_time")
        .agg(_several("data_version").alias("several"))
        .filter("several")
        .select(F.lit("mixed_data_version").alias("problem"), F.concat_ws("@", "security_id", F.date_format("fill_time", "yyyy-MM-dd")).alias("subject"))
    )
    return dup.unionByName(early).unionByName(mixed)


def portfolio_audit(positions: DataFrame) -> DataFrame:
    return positions.filter((F.col("cash") < 0) | (F.col("quantity") < 0))


def duplicate_intents(intents: DataFrame) -> DataFrame:
    g = intents.groupBy("decision_time", "security_id", "action").agg(F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") > 1)


def outside_universe(intents: DataFrame, membership: DataFrame, held: DataFrame) -> DataFrame:
    """Orders for non-members, unless they sell a holding. Membership is joined on equality plus range."""
    m = membership.select(F.col("security_id").alias("_m"), "valid_from", "valid_to")
    inside = (
        (F.col("security_id") == F.col("_m"))
        & (F.col("decision_time") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("decision_time") < F.col("valid_to")))
    )
    stray = intents.join(m, inside, "left_anti")
    selling = stray.join(held.select("security_id").distinct(), "security_id", "left_semi").filter(F.col("action") == "SELL")
    return stray.join(selling.select("decision_id"), "decision_id", "left_anti")


def wrong_checkpoint(fills: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Fills not executed at the first checkpoint after their decision. ``checkpoints`` has one row per session."""
    nxt = checkpoints.select("checkpoint", F.lead("checkpoint").over(Window.orderBy("checkpoint")).alias("expected"))
    known = calendar_join(fills, nxt, "decision_time", "checkpoint")
    return known.filter(F.col("expected").isNull() | (F.col("fill_time") != F.col("expected")))


def unpriced_positions(positions: DataFrame, prices: DataFrame) -> DataFrame:
    return positions.join(prices.select("security_id", "ts"), ["security_id", "ts"], "left_anti")


def delisted_at_cost(positions: DataFrame, prices: DataFrame, master: DataFrame) -> DataFrame:
    """Unpriced positions of names delisted at that time."""
    gone = master.filter(F.col("status") == "DELISTED").select(F.col("security_id").alias("_m"), "valid_from")
    missing = unpriced_positions(positions, prices)
    return missing.join(gone, (F.col("security_id") == F.col("_m")) & (F.col("ts") >= F.col("valid_from")), "left_semi")


def early_actions(used: DataFrame) -> DataFrame:
    """Actions applied before they were available."""
    return used.filter(F.col("applied_time") < F.col("available_time"))


def checkpoint_disorder(checkpoints: DataFrame, sequence: str) -> DataFrame:
    """Checkpoints not after the one before them in sequence; one row per session."""
    w = Window.orderBy(sequence)
    return checkpoints.withColumn("before", F.lag("checkpoint").over(w)).filter(F.col("checkpoint") <= F.col("before"))
