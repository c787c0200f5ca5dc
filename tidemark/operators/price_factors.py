"""Price factors and formulaic alphas.

Each factor is an aggregate over its own window of the bar panel, so any set of them is scored in one pass:
one fan-out of bars to moments, one sort, one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import change, corr_of, fallback_null, finite, ratio, volatility
from tidemark.functions.regression import gram_sums, r_squared
from tidemark.operators.panel import bar_panel, market_panel, padded

MONTH = 21  # trading days


class View:
    """Columns of the shared panel restricted to one factor's window."""

    def __init__(self, pad: int, keep: int | None):
        since = F.col("as_of") - F.make_dt_interval(F.lit(pad))
        self.inside = F.col("ts") >= since
        linked = F.col("prev_ts") >= since
        if keep is not None:
            self.inside = self.inside & (F.col("rn") <= keep)
            linked = linked & (F.col("rn") < keep)
        self.linked = self.inside & linked

    def only(self, x, cond: Column | None = None) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        return F.when(self.inside if cond is None else self.inside & cond, x)

    @property
    def n(self) -> Column:
        return F.count(self.only(F.lit(1)))

    @property
    def ret(self) -> Column:
        return F.when(self.linked, F.col("ret"))

    def at(self, rank: int, x="px") -> Column:
        """Value at a rank, 1 being the newest bar."""
        return F.max(self.only(x, F.col("rn") == rank))

    def first(self, x="px") -> Column:
        return F.min_by(F.col(x), self.only("ts"))

    def mean(self, x, lo: int, hi: int | None = None) -> Column:
        cond = F.col("rn") >= lo
        return F.avg(self.only(x, cond if hi is None else cond & (F.col("rn") <= hi)))


@dataclass(frozen=True)
class Factor:
    name: str
    pad: int
    keep: int | None
    score: Callable[[View], Column]


FACTORS: dict[str, Factor] = {}


def factor(name: str, lookback: int | None = None, pad: int | None = None, keep: int | None = None):
    """Register a factor over the last lookback+1 bars within the padded calendar range."""

    def add(score):
        p = padded(lookback) if pad is None else pad
        k = keep if keep is not None or lookback is None else lookback + 1
        FACTORS[name] = Factor(name, p, k, score)
        return score

    return add


def score_factors(
    revisions: DataFrame,
    grid: Sequence[datetime],
    names: Sequence[str],
    flags: DataFrame | None = None,
) -> DataFrame:
    """``(security_id, as_of, <name>...)`` for all named factors in one aggregation."""
    chosen = [FACTORS[n] for n in names]
    keeps = [f.keep for f in chosen]
    panel = bar_panel(revisions, grid, max(f.pad for f in chosen), None if None in keeps else max(keeps), flags)
    by_time = Window.partitionBy("security_id", "as_of").orderBy("ts")
    panel = (
        panel.withColumn("prev_ts", F.lag("ts").over(by_time))
        .withColumn("prev_hi", F.lag("adjusted_high").over(by_time))
        .withColumn("prev_lo", F.lag("adjusted_low").over(by_time))
    )
    return panel.groupBy("security_id", "as_of").agg(*[f.score(View(f.pad, f.keep)).alias(f.name) for f in chosen])


# ---- returns and risk ------------------------------------------------------------------------


@factor("low_volatility", 126)
def _low_volatility(v: View) -> Column:
    return -volatility(v.ret)


def _reversal(v: View) -> Column:
    return F.when(v.n >= 2, -change(v.at(1), v.first()))


factor("long_term_reversal", 36 * MONTH)(_reversal)
factor("short_term_reversal", 1 * MONTH)(_reversal)


@factor("illiquidity", 252)
def _illiquidity(v: View) -> Column:
    money = F.when(F.col("close") * F.col("volume") > 0, F.col("close") * F.col("volume"))
    per_money = ratio(F.abs(v.ret), money)
    return F.when(F.count(per_money) >= 20, F.avg(per_money))


@factor("fifty_two_week_high", 252)
def _year_high(v: View) -> Column:
    top = F.max(v.only("close", F.col("close") > 0))
    return F.when((v.n >= 2) & (v.at(1, "close") > 0), ratio(v.at(1, "close"), top))


@factor("max_effect", 21)
def _max_effect(v: View) -> Column:
    return F.when(F.count(v.ret) >= 2, -F.max(v.ret))


def _volumes(v: View, recent: int) -> tuple[Column, Column, Column, Column]:
    good = F.col("volume") >= 0
    new, old = F.col("rn") <= recent, F.col("rn") > recent
    return (
        F.avg(v.only("volume", good & new)),
        F.count(v.only("volume", good & new)),
        F.avg(v.only("volume", good & old)),
        F.count(v.only("volume", good & old)),
    )


@factor("high_volume_return_premium", 55)
def _volume_premium(v: View) -> Column:
    new, n_new, old, n_old = _volumes(v, 5)
    return F.when((v.n >= 55) & (n_old >= 50) & (n_new >= 5) & (old > 0), change(new, old))


@factor("volume_surge_price_absorption", 65)
def _volume_surge(v: View) -> Column:
    new, n_new, old, n_old = _volumes(v, 5)
    moved = F.abs(change(v.at(1), v.at(6))) + 0.01
    return F.when((v.n >= 66) & (n_old >= 60) & (n_new >= 5) & (old > 0), ratio(new, old) / moved)


@factor("large_cap_bearish_ma", 60)
def _bearish_ma(v: View) -> Column:
    last60 = F.col("rn") <= 60
    short, mid, long = v.mean("px", 1, 5), v.mean("px", 1, 20), v.mean("px", 1, 60)
    money = F.avg(v.only(F.col("px") * F.col("volume"), last60))
    bad = F.count_if(v.inside & last60 & (F.col("volume").isNull() | (F.col("volume") < 0)))
    ordered = (long > 0) & (short < mid) & (mid < long)
    return F.when((v.n >= 60) & (bad == 0) & ordered & (money > 0), F.ln(money + 1.0) * ratio(long - short, long))


@factor("intermediate_momentum", 12 * MONTH)
def _intermediate(v: View) -> Column:
    return F.when(v.n >= 253, change(v.at(7 * MONTH + 1), v.at(12 * MONTH + 1)))


@factor("frog_in_the_pan", 12 * MONTH)
def _frog(v: View) -> Column:
    skip = F.col("rn") > MONTH
    r = F.when(skip, v.ret)
    gain = change(v.at(MONTH + 1), v.at(12 * MONTH + 1))
    down, up = F.avg((r < 0).cast("double")), F.avg((r > 0).cast("double"))
    positive = F.min(v.only("px", skip)) > 0
    return F.when((v.n >= 253) & positive & (gain != 0), gain * -(F.signum(gain) * (down - up)))


@factor("rs_rating", 252)
def _rs(v: View) -> Column:
    def back(k):
        old = v.at(k + 1)
        return F.when(old > 0, ratio(v.at(1) - old, old))

    return F.when(v.n >= 253, F.lit(2.0) * back(63) + back(126) + back(189) + back(252))


@factor("return_seasonality", pad=5 * 366 + 40)
def _seasonality(v: View) -> Column:
    month = F.trunc("ts", "month")
    parts = []
    for years in range(1, 6):
        target = F.add_months(F.trunc("as_of", "month"), -12 * years)
        last = F.max_by(F.col("px"), v.only("ts", month == target))
        before = F.max_by(F.col("px"), v.only("ts", month == F.add_months(target, -1)))
        parts.append(F.when(before > 0, change(last, before)))
    known = F.array_compact(F.array(*parts))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) >= 2, total / F.size(known))


@factor("bid_ask_spread", pad=int((21 + 10) * 1.6), keep=23)
def _spread(v: View) -> Column:
    hi, lo, hi0, lo0 = (F.col(x) for x in ("adjusted_high", "adjusted_low", "prev_hi", "prev_lo"))
    usable = v.linked & (hi > 0) & (lo > 0) & (hi0 > 0) & (lo0 > 0)
    k = 3.0 - 2.0 * 2.0**0.5
    beta = F.pow(F.ln(hi / lo), 2) + F.pow(F.ln(hi0 / lo0), 2)
    gamma = F.pow(F.ln(F.greatest(hi, hi0) / F.least(lo, lo0)), 2)
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    day = F.when(usable, F.greatest(2.0 * (F.exp(alpha) - 1.0) / (1.0 + F.exp(alpha)), F.lit(0.0)))
    return F.when(F.count(day) >= 12, F.avg(day))


@factor("long_term_momentum", pad=12 * MONTH * 2, keep=12 * MONTH + 1)
def _momentum12(v: View) -> Column:
    return F.when(v.n >= 2, change(v.at(1), v.first()))


@factor("realized_vol_90", 90)
def _vol90(v: View) -> Column:
    return F.when(F.count(v.ret) >= 2, volatility(v.ret))


@factor("simple_momentum", pad=40)
def _simple_momentum(v: View) -> Column:
    return F.when(v.n >= 2, change(v.at(1), v.first()))


@factor("trend_gap", 9 * MONTH)
def _trend_gap(v: View) -> Column:
    mean = F.avg(v.only("px"))
    return F.when((v.n >= 2) & (mean > 0), v.at(1) - mean)


def trend_volatility(revisions: DataFrame, grid: Sequence[datetime], limit: float = 0.35) -> DataFrame:
    """Pass when the price is above its 9-month mean and 90-day volatility is within the limit."""
    both = score_factors(revisions, grid, ["trend_gap", "realized_vol_90"])
    ok = (F.col("trend_gap") > 0) & (F.col("realized_vol_90") <= limit)
    return both.select("security_id", "as_of", F.coalesce(ok, F.lit(False)).alias("passed"))


@factor("industry_return", 126)
def _industry_return(v: View) -> Column:
    return F.when((v.n >= 2) & (v.first() > 0), change(v.at(1), v.first()))


# ---- formulaic alphas ------------------------------------------------------------------------


def alpha(name: str, n: int):
    """Alpha over exactly the last n bars; anything not finite becomes NULL."""

    def add(score):
        factor(name, pad=int(n * 1.6) + 5, keep=n)(lambda v: F.when(v.n >= n, finite(score(v))))
        return score

    return add


@alpha("alpha101_006", 10)
def _alpha6(v: View) -> Column:
    return -corr_of(v.only("open"), v.only("volume"))


def _close(v: View, rank: int) -> Column:
    return v.at(rank, "px_null")


@alpha("alpha101_009", 6)
def _alpha9(v: View) -> Column:
    moves = [_close(v, k) - _close(v, k + 1) for k in range(1, 6)]
    one_way = (F.least(*moves) > 0) | (F.greatest(*moves) < 0)
    return F.when(one_way, moves[0]).otherwise(-moves[0])


@alpha("alpha101_012", 2)
def _alpha12(v: View) -> Column:
    return F.signum(v.at(1, "volume") - v.at(2, "volume")) * -(_close(v, 1) - _close(v, 2))


@alpha("alpha101_023", 20)
def _alpha23(v: View) -> Column:
    high = fallback_null("adjusted_high", "high")
    now = v.at(1, high)
    return F.when(F.avg(v.only(high)) < now, -(now - v.at(3, high))).otherwise(0.0)


def _curve(v: View) -> Column:
    return (_close(v, 21) - _close(v, 11)) / 10.0 - (_close(v, 11) - _close(v, 1)) / 10.0


@alpha("alpha101_046", 21)
def _alpha46(v: View) -> Column:
    x = _curve(v)
    return F.when(x > 0.25, -1.0).when(x < 0.0, 1.0).otherwise(-(_close(v, 1) - _close(v, 2)))


@alpha("alpha101_049", 21)
def _alpha49(v: View) -> Column:
    return F.when(_curve(v) < -0.1, 1.0).otherwise(-(_close(v, 1) - _close(v, 2)))


@alpha("alpha101_051", 21)
def _alpha51(v: View) -> Column:
    return F.when(_curve(v) < -0.05, 1.0).otherwise(-(_close(v, 1) - _close(v, 2)))


@alpha("alpha101_053", 10)
def _alpha53(v: View) -> Column:
    o, h, lo = F.col("close"), F.col("high"), F.col("low")
    x = ratio((o - lo) - (h - o), o - lo)
    return -(v.at(1, x) - v.at(10, x))


@alpha("alpha101_054", 1)
def _alpha54(v: View) -> Column:
    o, h, lo, c = (v.at(1, x) for x in ("open", "high", "low", "close"))
    return ratio(-(lo - c) * F.pow(o, 5), (lo - h) * F.pow(c, 5))


@alpha("alpha101_101", 1)
def _alpha101(v: View) -> Column:
    o, h, lo, c = (v.at(1, x) for x in ("open", "high", "low", "close"))
    return (c - o) / ((h - lo) + 0.001)


# ---- factors against the market --------------------------------------------------------------

PAIR = ("security_id", "as_of")


def _pairs(panel: DataFrame) -> DataFrame:
    """Rows with a market-side mean, slope and intercept of their window attached."""
    w = Window.partitionBy(*PAIR)
    return (
        panel.withColumn("m_mean", F.avg("m").over(w))
        .withColumn("slope", F.regr_slope("s", "m").over(w))
        .withColumn("icept", F.regr_intercept("s", "m").over(w))
        .withColumn("resid", F.col("s") - F.col("icept") - F.col("slope") * F.col("m"))
    )


def _score(panel: DataFrame, enough: Column, value: Column) -> DataFrame:
    return panel.groupBy(*PAIR).agg(F.when(enough, value).alias("score"))


def _count() -> Column:
    return F.count("s")


def low_beta(revisions: DataFrame, benchmark: DataFrame, grid: Sequence[datetime], lookback: int = 252) -> DataFrame:
    """Negative market beta, at least 20 common returns."""
    p = market_panel(revisions, benchmark, grid, lookback)
    return _score(p, _count() >= 20, -ratio(F.covar_samp("s", "m"), F.var_samp("m")))


def idiosyncratic_volatility(revisions, benchmark, grid, lookback: int = 21) -> DataFrame:
    """Negative sample deviation of market-model residuals, at least 15 returns."""
    p = _pairs(market_panel(revisions, benchmark, grid, lookback))
    return _score(p, (_count() >= 15) & (F.var_samp("m") > 0), -F.stddev_samp("resid"))


def idiosyncratic_skewness(revisions, benchmark, grid, lookback: int = 21) -> DataFrame:
    """Negative population skewness of market-model residuals."""
    p = _pairs(market_panel(revisions, benchmark, grid, lookback))
    return _score(p, (_count() >= 15) & (F.var_samp("m") > 0) & (F.stddev_pop("resid") > 0), -F.skewness("resid"))


def downside_beta(revisions, benchmark, grid, lookback: int = 252) -> DataFrame:
    """Beta over days on which the market is below its mean; at least 20 such days."""
    p = _pairs(market_panel(revisions, benchmark, grid, lookback))
    low = F.col("m") < F.col("m_mean")
    s, m = F.when(low, F.col("s")), F.when(low, F.col("m"))
    return _score(p, (_count() >= 20) & (F.count(s) >= 20), ratio(F.covar_samp(s, m), F.var_samp(m)))


def coskewness(revisions, benchmark, grid, lookback: int = 252) -> DataFrame:
    """Negative mean of e_i * e_m^2 over the root of both variances, all population moments."""
    w = Window.partitionBy(*PAIR)
    p = market_panel(revisions, benchmark, grid, lookback)
    p = p.withColumn("es", F.col("s") - F.avg("s").over(w)).withColumn("em", F.col("m") - F.avg("m").over(w))
    spread = F.sqrt(F.var_pop("s") * F.var_pop("m"))
    return _score(p, _count() >= 20, -ratio(F.avg(F.col("es") * F.col("em") * F.col("em")), spread))


def residual_momentum(
    revisions, benchmark, grid, estimation: int = 252, formation: int = 63, least_est: int = 200, least_form: int = 40
) -> DataFrame:
    """Mean over deviation of the newest residuals, the market model being fitted on the days before them."""
    p = market_panel(revisions, benchmark, grid, estimation + formation)
    w = Window.partitionBy(*PAIR)
    p = p.withColumn("n", F.count("s").over(w)).withColumn("i", F.col("day_no") - 1)
    p = p.withColumn("form", F.col("i") > F.col("n") - F.least(F.lit(formation), F.col("n") - least_est))
    s_e, m_e = F.when(~F.col("form"), F.col("s")), F.when(~F.col("form"), F.col("m"))
    p = p.withColumn("b", F.regr_slope(s_e, m_e).over(w)).withColumn("a", F.regr_intercept(s_e, m_e).over(w))
    resid = F.when(F.col("form"), F.col("s") - F.col("a") - F.col("b") * F.col("m"))
    enough = (F.max("n") >= least_est + least_form) & (F.count(resid) >= least_form)
    return _score(p, enough, ratio(F.avg(resid), F.stddev_samp(resid)))


def weekly_closes(panel: DataFrame) -> DataFrame:
    """Last price per ISO week of each (security, moment)."""
    week = F.date_trunc("week", "ts")
    return panel.filter(F.col("px") != 0).groupBy(*PAIR, week.alias("week")).agg(F.max_by("px", "ts").alias("px"))


def price_delay(revisions, benchmark, grid, weeks: int = 52, lags: int = 4) -> DataFrame:
    """1 - R2 of the same-week market return over R2 with the lagged market weeks added."""
    pad = int((weeks + lags + 2) * 7 * 1.1)
    own = weekly_closes(bar_panel(revisions, grid, pad, None))
    market = weekly_closes(bar_panel(benchmark, grid, pad, None)).drop("security_id").withColumnRenamed("px", "mpx")
    newest = Window.partitionBy("as_of").orderBy(F.desc("week"))
    by_week = Window.partitionBy("as_of").orderBy("week")
    market = market.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= weeks + lags + 1)
    market = market.withColumn("m", change("mpx", F.lag("mpx").over(by_week))).withColumn("no", F.row_number().over(by_week))
    for k in range(1, lags + 1):
        market = market.withColumn(f"m{k}", F.lag("m", k).over(by_week))
    own_by_week = Window.partitionBy(*PAIR).orderBy("no")
    both = own.join(market, ["as_of", "week"])
    both = both.withColumn("y", F.when(F.lag("no").over(own_by_week) == F.col("no") - 1, change("px", F.lag("px").over(own_by_week))))
    xs = ["m"] + [f"m{k}" for k in range(1, lags + 1)]
    usable = both.filter(F.col("y").isNotNull() & F.col(f"m{lags}").isNotNull())
    sums = usable.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), gram_sums("y", ["m"]).alias("short"), gram_sums("y", xs).alias("full")
    )
    both_r2 = sums.withColumn("r_short", r_squared("short")).withColumn("r_full", r_squared("full"))
    ok = (F.col("n") >= max(26, lags + 3)) & (F.col("r_full") > 0)
    return both_r2.select(*PAIR, F.when(ok, F.lit(1.0) - ratio("r_short", "r_full")).alias("score"))


def industry_momentum(returns: DataFrame, sector: DataFrame) -> DataFrame:
    """Mean return of the security's sector per moment; sectors need two members."""
    w = Window.partitionBy("as_of", "sector")
    joined = returns.filter(F.col("industry_return").isNotNull()).join(sector, "security_id")
    return (
        joined.withColumn("members", F.count(F.lit(1)).over(w))
        .withColumn("score", F.avg("industry_return").over(w))
        .filter(F.col("members") >= 2)
        .select("security_id", "as_of", "score")
    )
