"""Predictions, decisions, sizes and risk limits as column cascades over a joined table (one row per decision)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import average_rank, change, finite, ratio, volatility
from tidemark.operators.panel import bar_panel

KEY = ("security_id", "as_of")
# fixed parameters of the baseline rules
LOOKBACK, HORIZON, MIN_COMPLETE = 60, 5, 0.75
MIN_CONFIDENCE, MIN_RETURN, EXIT_RETURN, MAX_WEIGHT = 0.75, 0.005, -0.005, 0.10
REFERENCE_VOL, MAX_VOL, MIN_VOL_SCALE, LOW_LIQUIDITY_SCALE, CASH_MARGIN, LOT = 0.20, 0.80, 0.10, 0.50, 0.02, 1.0
COMMISSION, PER_SHARE, SPREAD_BPS, SLIPPAGE_BPS, IMPACT_BPS = 1.0, 0.005, 2.0, 5.0, 100.0


def random_walk(probes: DataFrame) -> DataFrame:
    return probes.select(*KEY, F.lit(0.0).alias("expected_return"), F.lit(0.5).alias("probability"), F.lit(1.0).alias("confidence"))


def drift(revisions: DataFrame, grid: Sequence[datetime]) -> DataFrame:
    """Compounded mean return of all bars in 2 x lookback calendar days; NULL under 75 % completeness."""
    by_time = Window.partitionBy(*KEY).orderBy("ts")
    p = bar_panel(revisions, grid, LOOKBACK * 2, None).withColumn("r", change("px_null", F.lag("px_null").over(by_time)))
    n, reliability = F.count(F.lit(1)), F.least(F.lit(1.0), F.count(F.lit(1)) / float(LOOKBACK + 1))
    ok = (n >= 2) & (reliability >= MIN_COMPLETE) & (F.count("r") >= 2)
    return p.groupBy(*KEY).agg(
        F.when(ok, F.pow(1.0 + F.avg("r"), HORIZON) - 1.0).alias("expected_return"),
        F.when(ok, F.avg(F.when(F.col("r").isNotNull(), (F.col("r") > 0).cast("double")))).alias("probability"),
        F.when(ok, volatility("r")).alias("expected_volatility"),
        F.when(ok, F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("uncertainty"),
        reliability.alias("confidence"),
    )


def regime_aware(predictions: DataFrame, regimes: DataFrame) -> DataFrame:
    """Return and confidence halved under EXTREME volatility."""
    j = predictions.join(regimes.select(*KEY, "volatility"), list(KEY), "left")
    scale = F.when((F.col("volatility") == "EXTREME") & F.col("expected_return").isNotNull(), 0.5).otherwise(1.0)
    return j.withColumn("expected_return", F.col("expected_return") * scale).withColumn("confidence", F.col("confidence") * scale)


def decide(book: DataFrame) -> DataFrame:
    """First matching rule wins: action and reason."""
    er, un = F.col("expected_return"), F.col("uncertainty")
    reason = (
        F.when(er.isNull() | F.col("confidence").isNull(), "prediction_unavailable")
        .when(finite(er).isNull() | (un.isNotNull() & finite(un).isNull()), "non_finite_prediction_value")
        .when(F.col("confidence") < MIN_CONFIDENCE, "confidence_below_threshold")
        .when(un.isNotNull() & (F.abs(er) <= un), "uncertainty_exceeds_signal")
        .when(F.col("trend") == "UNKNOWN", "regime_trend_unknown")
        .when(F.col("stress") == "UNKNOWN", "regime_stress_unknown")
        .when(F.col("stress") == "HIGH", "regime_stress_high")
        .when(F.col("portfolio_value").isNull(), "portfolio_state_unavailable")
        .when((er >= MIN_RETURN) & (F.col("quantity") > 0), "already_positioned_positive_signal")
        .when(er >= MIN_RETURN, "positive_expected_return_above_threshold")
        .when((er <= EXIT_RETURN) & (F.col("quantity") > 0), "negative_expected_return_below_threshold")
        .when(er <= EXIT_RETURN, "negative_signal_no_position_to_exit")
        .otherwise("expected_return_below_threshold")
    )
    out = book.withColumn("decision_reason", reason)
    action = (
        F.when(F.col("decision_reason") == "already_positioned_positive_signal", "HOLD")
        .when(F.col("decision_reason") == "positive_expected_return_above_threshold", "BUY")
        .when(F.col("decision_reason") == "negative_expected_return_below_threshold", "SELL")
        .otherwise("NO_TRADE")
    )
    hint = F.when(F.col("decision_action") == "BUY", F.least(F.lit(MAX_WEIGHT), F.col("confidence") * MAX_WEIGHT)).when(F.col("decision_action") == "SELL", 0.0)
    return out.withColumn("decision_action", action).withColumn("weight_hint", hint)


def size(book: DataFrame, risk_budget: float = 1.0) -> DataFrame:
    """weight = 10 % x confidence x volatility scale x liquidity scale, capped by cash and budget, floored to lots."""
    a, vol, value, price = F.col("decision_action"), F.col("expected_volatility"), F.col("portfolio_value"), F.col("price")
    scale = F.when(vol > REFERENCE_VOL, F.greatest(F.lit(MIN_VOL_SCALE), ratio(REFERENCE_VOL, vol))).otherwise(1.0)
    liquid = F.when(F.col("liquidity") == "LOW", LOW_LIQUIDITY_SCALE).otherwise(1.0)
    base = F.lit(MAX_WEIGHT) * F.col("confidence") * scale * liquid
    by_cash = ratio(F.greatest(F.lit(0.0), F.col("cash") * (1 - CASH_MARGIN)), value)
    budget = F.lit(risk_budget * MAX_WEIGHT)
    b = book.withColumn("base", base).withColumn("by_cash", by_cash).withColumn("bound", F.least("base", "by_cash", budget))
    b = b.withColumn("lots", F.floor(ratio(F.col("bound") * value, price) / LOT) * LOT)
    cut = F.col("bound") < F.col("base") - 1e-12
    rule = (
        F.when(a.isNull(), "UNKNOWN:decision_unavailable")
        .when(a.isin("HOLD", "NO_TRADE"), F.concat(F.lit("PASS:no_new_sizing_for_"), F.lower(a)))
        .when(finite(value).isNull() | (value <= 0) | finite("cash").isNull(), "UNKNOWN:invalid_portfolio_value")
        .when(a.isin("SELL", "EXIT"), "PASS:full_exit")
        .when(F.col("quantity") != 0, "UNKNOWN:unexpected_existing_position_for_buy")
        .when(finite("confidence").isNull() | ~F.col("confidence").between(0.0, 1.0), "UNKNOWN:invalid_confidence")
        .when(vol.isNull(), "REJECT:volatility_unavailable")
        .when(finite(vol).isNull() | (vol < 0), "REJECT:invalid_volatility")
        .when(vol >= MAX_VOL, "REJECT:volatility_exceeds_limit")
        .when(F.col("liquidity") == "UNKNOWN", "REJECT:liquidity_unknown")
        .when(finite(price).isNull() | (price <= 0), "REJECT:missing_price_data")
        .when(F.col("lots") <= 0, "REJECT:sized_to_zero")
        .when(cut & (F.col("by_cash") <= budget), "REDUCE:cash_shortage")
        .when(cut, "REDUCE:risk_budget_exceeded")
        .otherwise("PASS:normal_sizing")
    )
    b = b.withColumn("_rule", rule)
    b = b.withColumn("size_status", F.split("_rule", ":")[0]).withColumn("size_reason", F.split("_rule", ":")[1])
    sized = (a == "BUY") & F.col("size_status").isin("PASS", "REDUCE")
    quantity = F.when(sized, F.col("lots")).when((F.col("size_status") == "REJECT") | (a == "SELL"), 0.0).when(a.isin("HOLD", "NO_TRADE"), F.col("quantity"))
    weight = F.when(sized, ratio(F.col("lots") * price, value)).when(F.col("size_status") == "REJECT", 0.0)
    return b.withColumn("target_quantity", quantity).withColumn("target_weight", weight).drop("_rule", "base", "by_cash", "bound", "lots")


@dataclass(frozen=True)
class RiskLimits:
    """Limits of the risk cascade; None switches a limit off."""

    min_cash_ratio: float = 0.05
    max_position: float = 0.10
    max_gross: float = 1.0
    concentration: float = 0.25
    max_order: float | None = None
    max_drawdown: float | None = 0.20
    max_volatility: float | None = 0.30
    max_turnover: float | None = None
    max_sector: float | None = None
    cooldown_days: int | None = None


def risk_state(positions: DataFrame, limits: RiskLimits = RiskLimits()) -> DataFrame:
    """Weights per portfolio: gross, concentration, largest sector and use of the gross limit.

    ``positions``: (portfolio, security_id, sector, market_value, portfolio_value).
    """
    p = positions.filter(F.col("market_value") != 0).withColumn("w", ratio("market_value", "portfolio_value"))
    sectors = p.groupBy("portfolio", "sector").agg(F.sum("w").alias("sw")).groupBy("portfolio").agg(F.max(F.when(F.col("sector").isNotNull(), F.col("sw"))).alias("top_sector"))
    g = p.groupBy("portfolio").agg(F.sum("w").alias("gross"), F.max("w").alias("concentration"), F.count(F.lit(1)).alias("positions"))
    return g.join(sectors, "portfolio").withColumn("budget_usage", F.col("gross") / limits.max_gross)


def weekdays_between(start: Column, end: Column) -> Column:
    """Weekdays in (start, end]: whole weeks plus the rest, no day list."""
    def monday_based(day):  # weekdays since a Monday epoch day 4 (1970-01-05)
        days = F.datediff(day, F.lit("1970-01-05").cast("date"))
        return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)) + 1, F.lit(5))

    return F.greatest(F.lit(0), monday_based(end) - monday_based(start)).cast("int")


def assess(book: DataFrame, limits: RiskLimits = RiskLimits(), prefix: str = "risk") -> DataFrame:
    """Ordered limits clamp the weight or reject; the limits hit are listed in order."""
    value, cash = F.col("portfolio_value"), F.col("cash")
    b = book.withColumn("_w", F.col("target_weight")).withColumn("_hit", F.array().cast("array<string>")).withColumn("_no", F.lit(None).cast("string"))
    live = F.col("_no").isNull()

    def clamp(b: DataFrame, limit: Column, over: Column, name: str, dead: str | None = None) -> DataFrame:
        hit = live & over
        if dead is not None:
            fatal = hit & (limit <= 0)
            b = b.withColumn("_no", F.when(fatal, F.lit(dead)).otherwise(F.col("_no"))).withColumn("_dead", fatal)
            b = b.withColumn("_hit", F.when(F.col("_dead"), F.array(F.lit(name))).otherwise(F.col("_hit"))).drop("_dead")
            hit = F.col("_no").isNull() & over
        return b.withColumn("_hit", F.when(hit, F.concat("_hit", F.array(F.lit(name)))).otherwise(F.col("_hit"))).withColumn(
            "_w", F.when(hit, F.least(F.col("_w"), limit)).otherwise(F.col("_w"))
        )

    def reject(b: DataFrame, cond: Column, why: str, name: str) -> DataFrame:
        hit = live & F.coalesce(cond, F.lit(False))
        return b.withColumn("_hit", F.when(hit, F.concat("_hit", F.array(F.lit(name)))).otherwise(F.col("_hit"))).withColumn(
            "_no", F.when(hit, F.lit(why)).otherwise(F.col("_no"))
        )

    spare = ratio(F.greatest(F.lit(0.0), cash - limits.min_cash_ratio * value), value)
    b = clamp(b, spare, ratio(cash - F.col("_w") * value, value) < limits.min_cash_ratio, "cash_minimum", "cash_minimum_breach")
    b = clamp(b, F.lit(limits.max_position), F.col("_w") > limits.max_position, "single_position_limit")
    room = F.greatest(F.lit(0.0), F.lit(limits.max_gross) - F.col("gross"))
    b = clamp(b, room, F.col("gross") + F.col("_w") > limits.max_gross, "gross_exposure", "gross_exposure_limit_breached")
    b = clamp(b, F.lit(limits.concentration), F.col("_w") > limits.concentration, "concentration")
    if limits.max_order is not None:
        b = clamp(b, ratio(limits.max_order, value), F.col("_w") * value > limits.max_order, "max_order_notional")
    if limits.max_drawdown is not None:
        b = reject(b, F.col("drawdown").isNull(), "drawdown_unknown", "drawdown_unknown")
        b = reject(b, F.abs("drawdown") >= limits.max_drawdown, "drawdown_limit_breached", "drawdown_limit")
    if limits.max_volatility is not None:
        b = reject(b, F.col("portfolio_volatility").isNull(), "portfolio_volatility_unknown", "portfolio_volatility_unknown")
        b = reject(b, F.col("portfolio_volatility") > limits.max_volatility, "portfolio_volatility_limit_breached", "portfolio_volatility_limit")
    if limits.max_turnover is not None:
        b = reject(b, F.col("turnover").isNull(), "turnover_unknown", "turnover_unknown")
        b = reject(b, F.col("turnover") > limits.max_turnover, "turnover_limit_breached", "turnover_limit")
    if limits.max_sector is not None:
        b = reject(b, F.col("sector").isNull(), "sector_unknown", "sector_unknown")
        left = F.greatest(F.lit(0.0), F.lit(limits.max_sector) - F.col("sector_exposure"))
        over = F.col("sector_exposure") + F.col("_w") > limits.max_sector
        b = reject(b, over & (left <= 0), "sector_limit_breached", "sector_limit")
        b = clamp(b, left, over, "sector_limit")
    b = reject(b, F.col("liquidity") == "UNKNOWN", "liquidity_unknown", "liquidity_unknown")
    b = reject(b, F.col("liquidity") == "LOW", "liquidity_limit_breached", "liquidity_limit")
    if limits.cooldown_days is not None:
        since = weekdays_between(F.col("last_exit"), F.col("decision_time"))
        b = reject(b, F.col("last_exit").isNotNull() & (since < limits.cooldown_days), "reentry_cooldown_breached", "reentry_cooldown")
    last_hit = F.try_element_at("_hit", F.lit(-1))
    bad = F.col("target_weight").isNull() | F.col("target_quantity").isNull() | (F.col("target_weight") < 0)
    rule = (
        F.when(finite(value).isNull() | (value <= 0) | finite(cash).isNull(), "UNKNOWN:invalid_portfolio_value")
        .when(F.col("size_status").isNull(), "UNKNOWN:sizing_result_unavailable")
        .when(F.col("size_status").isin("UNKNOWN", "REJECT"), F.concat_ws(":", "size_status", "size_reason"))
        .when(F.col("decision_action") != "BUY", "PASS:no_new_risk_limit_applicable")
        .when(bad, "UNKNOWN:invalid_sizing_result")
        .when(F.col("_no").isNotNull(), F.concat(F.lit("REJECT:"), F.col("_no")))
        .when(F.col("_w") <= 0, F.concat(F.lit("REJECT:"), F.coalesce(last_hit, F.lit("sized_to_zero_by_risk_checks"))))
        .when(F.size("_hit") > 0, F.concat(F.lit("REDUCE:"), last_hit))
        .otherwise("PASS:risk_checks_passed")
    )
    checked = (F.col("decision_action") == "BUY") & F.col("size_status").isin("PASS", "REDUCE")
    b = b.withColumn("_rule", rule)
    status = F.split("_rule", ":")[0]
    b = b.withColumn(f"{prefix}_status", status).withColumn(f"{prefix}_reason", F.split("_rule", ":")[1])
    b = b.withColumn(f"{prefix}_limits", F.when(checked, F.array_join("_hit", "|")).otherwise(""))
    final = F.when(F.col(f"{prefix}_status") == "REJECT", 0.0).when(checked, F.col("_w")).when(F.col(f"{prefix}_status") == "PASS", F.col("target_weight"))
    return b.withColumn(f"{prefix}_weight", final).drop("_w", "_hit", "_no", "_rule")


def shadow(book: DataFrame, limits: RiskLimits, other: RiskLimits) -> DataFrame:
    """Two limit sets side by side and whether their status differs."""
    both = assess(assess(book, limits, "real"), other, "shadow")
    return both.withColumn("diverged", F.col("real_status") != F.col("shadow_status"))


# ---- costs ----------------------------------------------------------------------------------------


def commission(quantity: Column) -> Column:
    return F.when(quantity <= 0, 0.0).otherwise(F.lit(COMMISSION) + F.lit(PER_SHARE) * quantity)


def _by_side(price: Column, bps: Column, side: Column) -> Column:
    move = price * (bps / 10000.0)
    return F.when(side == "BUY", price + move).otherwise(price - move)


def spread_price(price: Column, side: Column) -> Column:
    return _by_side(price, F.lit(SPREAD_BPS / 2.0), side)


def fixed_slippage(price: Column, side: Column) -> Column:
    return _by_side(price, F.lit(SLIPPAGE_BPS), side)


def volume_slippage(price: Column, quantity: Column, side: Column, volume: Column) -> Column:
    share = F.when(volume > 0, ratio(quantity, volume)).otherwise(0.0)
    return _by_side(price, F.lit(SLIPPAGE_BPS) + F.lit(IMPACT_BPS) * share, side)


# ---- portfolios -------------------------------------------------------------------------------------


def rank_average_top(scores: DataFrame, legs: Sequence[str], top: int) -> DataFrame:
    """Names with the best mean of the legs' average ranks per date."""
    full = scores.dropna(subset=list(legs))
    ranked = full.select(*KEY, *[average_rank(x, "as_of").alias(x) for x in legs])
    mean = ranked.withColumn("combined", sum((F.col(x) for x in legs), F.lit(0.0)) / len(legs))
    k = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("combined"), "security_id"))
    return mean.withColumn("place", k).filter(F.col("place") <= top).select(*KEY, "combined", "place")


def inverse_volatility_weights(scores: DataFrame, top: int = 5, cap: float = 0.20, floor: float = 0.01) -> DataFrame:
    """Inverse-volatility weights among the top names of each date, capped."""
    k = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("score"), "security_id"))
    best = scores.filter(F.col("score").isNotNull()).withColumn("place", k).filter(F.col("place") <= top)
    inv = F.coalesce(ratio(1.0, F.greatest(F.col("vol"), F.lit(floor))), F.lit(0.0))
    total = F.sum(inv).over(Window.partitionBy("as_of"))
    return best.select(*KEY, "place", F.least(F.when(total > 0, inv / total), F.lit(cap)).alias("weight"))


def top_n_returns(scores: DataFrame, forward: DataFrame, top: int, cost: float) -> DataFrame:
    """Equal-weight top-N portfolio per rebalance date: gross return, turnover and return net of cost."""
    k = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("score"), "security_id"))
    held = scores.filter(F.col("score").isNotNull()).withColumn("k", k).filter(F.col("k") <= top).select(*KEY)
    size_ = F.count(F.lit(1)).over(Window.partitionBy("as_of"))
    held = held.withColumn("w", F.lit(1.0) / size_)
    dates = held.select("as_of").distinct()
    order = dates.withColumn("next", F.lead("as_of").over(Window.orderBy("as_of")))
    moved = held.join(order, "as_of").filter(F.col("next").isNotNull()).select("security_id", F.col("next").alias("as_of"), F.col("w").alias("w0"))
    change_ = held.join(moved, list(KEY), "full_outer").groupBy("as_of").agg(
        F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))).alias("turnover")
    )
    gross = held.join(forward, list(KEY), "left").groupBy("as_of").agg(F.sum(F.col("w") * F.coalesce("fwd", F.lit(0.0))).alias("gross"))
    return gross.join(change_, "as_of").withColumn("net", F.col("gross") - F.col("turnover") * cost)
