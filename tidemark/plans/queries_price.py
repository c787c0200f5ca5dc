"""Price factors and alphas on the quarterly grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import blocks
from tidemark.operators import price_factors as pf
from tidemark.operators.panel import bar_panel, padded
from tidemark.plans.domain import QUARTERS, Domain
from tidemark.plans.oracle import VIEWS, market_sql, panel_sql, solve_sql
from tidemark.plans.registry import query

COLS = "security_id:s, as_of:t, score:f"
BRAND, REGION = "bar_revisions", "region_revisions"


def _revisions(d: Domain, which: str):
    return d.bar_revisions if which == BRAND else d.region_revisions


def _factor(key: str, name: str, which: str, sql: str, digits: int = 6, long=None):
    """Register one panel factor; ``sql`` is the score over the group. A ``long`` window is read from block aggregates."""
    f = pf.FACTORS[name]
    text = f"SELECT security_id, as_of, {sql} AS score FROM {panel_sql(which, 'grid_q', f.pad, f.keep)} GROUP BY 1, 2"

    @query(key, f"security_id:s, as_of:t, score:f{digits}", text)
    def build(d: Domain):
        if long is not None:
            return long(_revisions(d, which), QUARTERS)
        return pf.score_factors(_revisions(d, which), QUARTERS, [name]).withColumnRenamed(name, "score")


def _at(k: int, x: str = "px") -> str:
    return f"max(CASE WHEN rn = {k} THEN {x} END)"


_VOL = "-(stddev_samp(ret) * sqrt(252.0::DOUBLE))"
_REV = "CASE WHEN count(*) >= 2 THEN -(arg_max(px, ts) / arg_min(px, ts) - 1) END"
_MOM = "CASE WHEN count(*) >= 2 THEN arg_max(px, ts) / arg_min(px, ts) - 1 END"

_factor("fpx_01_low_volatility", "low_volatility", BRAND, _VOL)
_factor("fpx_02_long_term_reversal", "long_term_reversal", REGION, _REV, long=blocks.long_term_reversal)
_factor("fpx_03_short_term_reversal", "short_term_reversal", BRAND, _REV)
_factor(
    "fpx_07_illiquidity",
    "illiquidity",
    REGION,
    "CASE WHEN count(CASE WHEN close * volume > 0 THEN ret END) >= 20 THEN avg(CASE WHEN close * volume > 0 THEN abs(ret) / (close * volume) END) END",
    9,
)
_factor("fpx_08_fifty_two_week_high", "fifty_two_week_high", REGION, f"CASE WHEN count(*) >= 2 THEN {_at(1, 'close')} / max(close) END", long=blocks.year_high)
_factor("fpx_09_max_effect", "max_effect", BRAND, "CASE WHEN count(ret) >= 2 THEN -max(ret) END")
_NEW, _OLD = "avg(CASE WHEN rn <= 5 THEN volume END)", "avg(CASE WHEN rn > 5 THEN volume END)"
_factor("fpx_13_high_volume_return_premium", "high_volume_return_premium", BRAND, f"CASE WHEN count(*) >= 55 THEN {_NEW} / {_OLD} - 1 END")
_factor(
    "fpx_14_volume_surge_price_absorption",
    "volume_surge_price_absorption",
    BRAND,
    f"CASE WHEN count(*) >= 66 THEN {_NEW} / {_OLD} / (abs({_at(1)} / {_at(6)} - 1) + 0.01::DOUBLE) END",
)
_factor(
    "fpx_15_large_cap_bearish_ma",
    "large_cap_bearish_ma",
    BRAND,
    """CASE WHEN count(*) >= 60 AND avg(CASE WHEN rn <= 5 THEN px END) < avg(CASE WHEN rn <= 20 THEN px END)
 AND avg(CASE WHEN rn <= 20 THEN px END) < avg(CASE WHEN rn <= 60 THEN px END)
 THEN ln(avg(CASE WHEN rn <= 60 THEN px * volume END) + 1) * (avg(CASE WHEN rn <= 60 THEN px END) - avg(CASE WHEN rn <= 5 THEN px END))
  / avg(CASE WHEN rn <= 60 THEN px END) END""",
)
_factor("fpx_16_intermediate_momentum", "intermediate_momentum", REGION, f"CASE WHEN count(*) >= 253 THEN {_at(148)} / {_at(253)} - 1 END")
_factor(
    "fpx_20_frog_in_the_pan",
    "frog_in_the_pan",
    REGION,
    f"""CASE WHEN count(*) >= 253 AND {_at(22)} <> {_at(253)} THEN ({_at(22)} / {_at(253)} - 1) * -(sign({_at(22)} / {_at(253)} - 1)
 * (avg(CASE WHEN rn > 21 AND ret IS NOT NULL THEN CAST(ret < 0 AS INT) END) - avg(CASE WHEN rn > 21 AND ret IS NOT NULL THEN CAST(ret > 0 AS INT) END))) END""",
)
_factor(
    "fpx_21_rs_rating",
    "rs_rating",
    REGION,
    "CASE WHEN count(*) >= 253 THEN "
    + " + ".join(f"{w}::DOUBLE * ({_at(1)} - {_at(k)}) / {_at(k)}" for w, k in ((2.0, 64), (1.0, 127), (1.0, 190), (1.0, 253)))
    + " END",
)
_SPREAD = pf.FACTORS["bid_ask_spread"]


@query(
    "fpx_24_bid_ask_spread",
    COLS,
    f"""SELECT security_id, as_of, CASE WHEN count(spread) >= 12 THEN avg(spread) END AS score FROM (
 SELECT *, CASE WHEN beta IS NOT NULL THEN greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0) END AS spread FROM (
 SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2.0::DOUBLE)) - sqrt(gamma / (3 - 2 * sqrt(2.0::DOUBLE))) AS alpha FROM (
 SELECT *, pow(ln(adjusted_high / adjusted_low), 2) + pow(ln(lag(adjusted_high) OVER k / lag(adjusted_low) OVER k), 2) AS beta,
  pow(ln(greatest(adjusted_high, lag(adjusted_high) OVER k) / least(adjusted_low, lag(adjusted_low) OVER k)), 2) AS gamma
 FROM {panel_sql(BRAND, 'grid_q', _SPREAD.pad, _SPREAD.keep)} WINDOW k AS (PARTITION BY security_id, as_of ORDER BY ts)))) GROUP BY 1, 2""",
)
def _spread(d: Domain):
    return pf.score_factors(d.bar_revisions, QUARTERS, ["bid_ask_spread"]).withColumnRenamed("bid_ask_spread", "score")


_factor("fpx_25_long_term_momentum", "long_term_momentum", REGION, _MOM, long=blocks.long_term_momentum)
_factor("fpx_26_realized_vol", "realized_vol_90", BRAND, "CASE WHEN count(ret) >= 2 THEN stddev_samp(ret) * sqrt(252.0::DOUBLE) END")
_factor("fpx_28_simple_momentum", "simple_momentum", BRAND, _MOM)

_CLOSE = [_at(k, "px_null") for k in range(0, 22)]
_CURVE = f"(({_CLOSE[21]} - {_CLOSE[11]}) / 10 - ({_CLOSE[11]} - {_CLOSE[1]}) / 10)"
_STEP = f"-({_CLOSE[1]} - {_CLOSE[2]})"
_MOVES = ", ".join(f"{_CLOSE[k]} - {_CLOSE[k + 1]}" for k in range(1, 6))
_HIGH = "coalesce(adjusted_high, high)"
_X53 = "((close - low) - (high - close)) / nullif(close - low, 0)"
_ALPHAS = {
    "006": (10, "-CASE WHEN var_pop(open) * var_pop(volume) > 0 THEN covar_pop(open, volume) / sqrt(var_pop(open) * var_pop(volume)) END"),
    "009": (6, f"CASE WHEN least({_MOVES}) > 0 OR greatest({_MOVES}) < 0 THEN 1 ELSE -1 END * ({_CLOSE[1]} - {_CLOSE[2]})"),
    "012": (2, f"sign({_at(1, 'volume')} - {_at(2, 'volume')}) * {_STEP}"),
    "023": (20, f"CASE WHEN avg({_HIGH}) < {_at(1, _HIGH)} THEN -({_at(1, _HIGH)} - {_at(3, _HIGH)}) ELSE 0 END"),
    "046": (21, f"CASE WHEN {_CURVE} > 0.25 THEN -1 WHEN {_CURVE} < 0 THEN 1 ELSE {_STEP} END"),
    "049": (21, f"CASE WHEN {_CURVE} < -0.1 THEN 1 ELSE {_STEP} END"),
    "051": (21, f"CASE WHEN {_CURVE} < -0.05 THEN 1 ELSE {_STEP} END"),
    "053": (10, f"-({_at(1, _X53)} - {_at(10, _X53)})"),
    "054": (1, "max(-(low - close) * pow(open, 5) / ((low - high) * pow(close, 5)))"),
    "101": (1, "max((close - open) / ((high - low) + 0.001::DOUBLE))"),
}
for _i, (_id, (_n, _sql)) in enumerate(_ALPHAS.items(), 1):
    _factor(f"alf_{_i:02d}_alpha101_{_id}", f"alpha101_{_id}", BRAND, f"CASE WHEN count(*) >= {_n} THEN {_sql} END")


_SEASON = pf.FACTORS["return_seasonality"]


@query(
    "fpx_23_return_seasonality",
    COLS,
    f"""WITH mon AS (SELECT security_id, as_of, CAST(date_trunc('month', ts) AS DATE) AS mo, arg_max(px, ts) AS px
FROM {panel_sql(BRAND, 'grid_q', _SEASON.pad, None)} GROUP BY 1, 2, 3),
yr AS (SELECT a.security_id, a.as_of, b.px / a.px - 1 AS r FROM mon a JOIN mon b ON a.security_id = b.security_id AND a.as_of = b.as_of
 AND b.mo = a.mo + INTERVAL 1 MONTH WHERE month(b.mo) = month(a.as_of) AND year(a.as_of) - year(b.mo) BETWEEN 1 AND 5)
SELECT m.security_id, m.as_of, CASE WHEN count(r) >= 2 THEN avg(r) END AS score
FROM (SELECT DISTINCT security_id, as_of FROM mon) m LEFT JOIN yr USING (security_id, as_of) GROUP BY 1, 2""",
)
def _seasonality(d: Domain):
    return blocks.return_seasonality(d.bar_revisions, QUARTERS)


def _market(key: str, fn, which: str, lookback: int, sql: str):
    @query(key, COLS, sql.replace("$PANEL", market_sql(which, "grid_q", lookback)))
    def build(d: Domain):
        return fn(_revisions(d, which), d.benchmark_bars, QUARTERS)


_GROUP = "SELECT security_id, as_of, {} AS score FROM $PANEL GROUP BY 1, 2"
_PAIRS = """SELECT security_id, as_of, {} AS score FROM (SELECT *, s - regr_intercept(s, m) OVER k - regr_slope(s, m) OVER k * m AS resid, avg(m) OVER k AS m_mean
 FROM $PANEL WINDOW k AS (PARTITION BY security_id, as_of)) GROUP BY 1, 2"""
_market("fpx_04_low_beta", pf.low_beta, REGION, 252, _GROUP.format("CASE WHEN count(s) >= 20 THEN -(covar_samp(s, m) / var_samp(m)) END"))
_market(
    "fpx_05_betting_against_correlation",
    blocks.betting_against_correlation,
    REGION,
    1260,
    """SELECT security_id, as_of, CASE WHEN count(*) >= 750 THEN -corr(ls, lm) END AS score FROM (
 SELECT *, ln(px / lag(px, 3) OVER k) AS ls, ln(mpx / lag(mpx, 3) OVER k) AS lm FROM $PANEL WINDOW k AS (PARTITION BY security_id, as_of ORDER BY ts)) GROUP BY 1, 2""",
)
_market(
    "fpx_06_idiosyncratic_volatility", pf.idiosyncratic_volatility, REGION, 21, _PAIRS.format("CASE WHEN count(s) >= 15 THEN -stddev_samp(resid) END")
)
_market(
    "fpx_10_idiosyncratic_skewness",
    pf.idiosyncratic_skewness,
    REGION,
    21,
    """SELECT security_id, as_of, CASE WHEN count(s) >= 15 THEN -(avg(pow(resid - r_mean, 3)) / pow(stddev_pop(resid), 3)) END AS score FROM (
 SELECT *, avg(resid) OVER (PARTITION BY security_id, as_of) AS r_mean FROM (
 SELECT *, s - regr_intercept(s, m) OVER k - regr_slope(s, m) OVER k * m AS resid FROM $PANEL WINDOW k AS (PARTITION BY security_id, as_of))) GROUP BY 1, 2""",
)
_market(
    "fpx_11_downside_beta",
    pf.downside_beta,
    REGION,
    252,
    _PAIRS.format("CASE WHEN count(s) >= 20 AND count(*) FILTER (WHERE m < m_mean) >= 20 THEN covar_samp(s, m) FILTER (WHERE m < m_mean) / var_samp(m) FILTER (WHERE m < m_mean) END"),
)
_market(
    "fpx_12_coskewness",
    pf.coskewness,
    REGION,
    252,
    """SELECT security_id, as_of, CASE WHEN count(s) >= 20 THEN -(avg(es * em * em) / sqrt(var_pop(s) * var_pop(m))) END AS score FROM (
 SELECT *, s - avg(s) OVER k AS es, m - avg(m) OVER k AS em FROM $PANEL WINDOW k AS (PARTITION BY security_id, as_of)) GROUP BY 1, 2""",
)
_market(
    "fpx_22_residual_momentum",
    pf.residual_momentum,
    REGION,
    315,
    """SELECT security_id, as_of, CASE WHEN max(n) >= 240 AND count(r) >= 40 THEN avg(r) / stddev_samp(r) END AS score FROM (
 SELECT *, CASE WHEN form THEN s - regr_intercept(se, me) OVER k - regr_slope(se, me) OVER k * m END AS r FROM (
 SELECT *, CASE WHEN NOT form THEN s END AS se, CASE WHEN NOT form THEN m END AS me FROM (
 SELECT *, day_no - 1 > n - least(63, n - 200) AS form FROM (SELECT *, count(s) OVER (PARTITION BY security_id, as_of) AS n FROM $PANEL)))
 WINDOW k AS (PARTITION BY security_id, as_of)) GROUP BY 1, 2""",
)


VIEWS["own_weeks"] = f"SELECT security_id, as_of, date_trunc('week', ts) AS wk, arg_max(px, ts) AS px FROM {panel_sql(REGION, 'grid_q', 446, None)} WHERE px <> 0 GROUP BY 1, 2, 3"
VIEWS["all_market_weeks"] = f"SELECT as_of, date_trunc('week', ts) AS wk, arg_max(px, ts) AS mpx FROM {panel_sql('benchmark_bars', 'grid_q', 446, None)} WHERE px <> 0 GROUP BY 1, 2"
VIEWS["market_weeks"] = """SELECT as_of, wk, mpx, row_number() OVER (PARTITION BY as_of ORDER BY wk) AS num FROM (
 SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY wk DESC) AS back FROM all_market_weeks) WHERE back <= 57"""
VIEWS["market_moves"] = "SELECT b.as_of, b.wk, b.num, b.mpx / a.mpx - 1 AS m FROM market_weeks b JOIN market_weeks a ON a.as_of = b.as_of AND a.num = b.num - 1"
VIEWS["paired_weeks"] = "SELECT o.security_id, o.as_of, w.num, o.px FROM own_weeks o JOIN market_weeks w ON o.as_of = w.as_of AND o.wk = w.wk"
_LAGS = " ".join(f"JOIN market_moves l{k} ON l{k}.as_of = b.as_of AND l{k}.num = b.num - {k}" for k in range(5))
VIEWS["delay_rows"] = f"""SELECT b.security_id, b.as_of, b.px / a.px - 1 AS y, l0.m AS m, l1.m AS m1, l2.m AS m2, l3.m AS m3, l4.m AS m4
 FROM paired_weeks b JOIN paired_weeks a ON a.security_id = b.security_id AND a.as_of = b.as_of AND a.num = b.num - 1 {_LAGS}"""
_SHORT, _FULL = (solve_sql("delay_rows", "y", xs, "security_id, as_of") for xs in (["m"], ["m", "m1", "m2", "m3", "m4"]))


@query(
    "fpx_17_price_delay",
    COLS,
    f"""SELECT g.security_id, g.as_of, CASE WHEN a.n >= 26 AND b.r2 > 0 THEN 1 - a.r2 / b.r2 END AS score FROM (SELECT DISTINCT security_id, as_of FROM delay_rows) g
 JOIN {_SHORT} a ON a.security_id = g.security_id AND a.as_of = g.as_of JOIN {_FULL} b ON b.security_id = g.security_id AND b.as_of = g.as_of""",
)
def _delay(d: Domain):
    return pf.price_delay(d.region_revisions, d.benchmark_bars, QUARTERS)


@query(
    "fpx_18_weekly_closes",
    "security_id:s, as_of:t, week:t, px:f",
    f"""SELECT security_id, as_of, date_trunc('week', ts) AS week, arg_max(px, ts) AS px
 FROM {panel_sql(BRAND, 'grid_q', 446, None)} WHERE px <> 0 GROUP BY 1, 2, 3""",
)
def _weekly(d: Domain):
    return pf.weekly_closes(bar_panel(d.bar_revisions, QUARTERS, 446, None))


@query("fpx_19_ols_r_squared", "security_id:s, as_of:t, r2:f", f"SELECT security_id, as_of, r2 FROM {solve_sql(market_sql(REGION, 'grid_q', 252), 's', ['m', 'm * m'], 'security_id, as_of', where='s IS NOT NULL')}")
def _r2(d: Domain):
    from tidemark.functions.regression import gram_sums, r_squared
    from tidemark.operators.panel import market_panel

    p = market_panel(d.region_revisions, d.benchmark_bars, QUARTERS, 252).filter(F.col("s").isNotNull())
    return p.groupBy("security_id", "as_of").agg(gram_sums("s", ["m", F.col("m") * F.col("m")]).alias("g")).select(
        "security_id", "as_of", r_squared("g").alias("r2")
    )


_IND = f"""SELECT security_id, as_of, CASE WHEN count(*) >= 2 THEN arg_max(px, ts) / arg_min(px, ts) - 1 END AS r
 FROM {panel_sql(BRAND, 'grid_q', padded(126), 127)} GROUP BY 1, 2"""


@query(
    "fpx_29_industry_momentum",
    COLS,
    f"""SELECT security_id, as_of, score FROM (SELECT security_id, as_of, avg(r) OVER k AS score, count(*) OVER k AS members
 FROM ({_IND}) JOIN sector USING (security_id) WHERE r IS NOT NULL WINDOW k AS (PARTITION BY as_of, sector)) WHERE members >= 2""",
)
def _industry(d: Domain):
    return pf.industry_momentum(pf.score_factors(d.bar_revisions, QUARTERS, ["industry_return"]), d.sector)


@query(
    "fpx_27_trend_volatility",
    "security_id:s, as_of:t, passed:b",
    f"""SELECT a.security_id, a.as_of, coalesce(gap > 0 AND vol <= 0.35, FALSE) AS passed FROM (
 SELECT security_id, as_of, CASE WHEN count(*) >= 2 THEN {_at(1)} - avg(px) END AS gap FROM {panel_sql(BRAND, 'grid_q', padded(189), 190)} GROUP BY 1, 2) a
 LEFT JOIN (SELECT security_id, as_of, stddev_samp(ret) * sqrt(252.0::DOUBLE) AS vol FROM {panel_sql(BRAND, 'grid_q', padded(90), 91)} GROUP BY 1, 2) b
 ON a.security_id = b.security_id AND a.as_of = b.as_of""",
)
def _trend(d: Domain):
    return pf.trend_volatility(d.bar_revisions, QUARTERS)
