"""Regime axes, macro signals and the decision cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import macro as mc
from tidemark.operators import performance as pf
from tidemark.operators import price_factors as px
from tidemark.operators import reads as rd
from tidemark.operators import regime as rg
from tidemark.operators import scoring as sc
from tidemark.operators import signals as sg
from tidemark.operators.panel import bar_panel
from tidemark.plans.domain import QUARTERS, Domain
from tidemark.plans.oracle import VIEWS, forward_sql, panel_sql
from tidemark.plans.queries_fundamental import _SQL as FACT_SQL
from tidemark.plans.queries_performance import nav, priced
from tidemark.plans.queries_price import _at
from tidemark.plans.queries_quality import positions
from tidemark.plans.registry import query

K = "security_id:s, as_of:t"
VIEWS["pts"] = f"SELECT * FROM {panel_sql('bar_revisions', 'grid_q', 365, None)}"
VIEWS["bench_pts"] = f"SELECT * FROM {panel_sql('benchmark_bars', 'grid_q', 365, None)}"
VIEWS["rg_trend"] = """SELECT *, CASE WHEN trend_value IS NULL THEN 'UNKNOWN' WHEN trend_value > 0.005 THEN 'BULL' WHEN trend_value < -0.005 THEN 'BEAR' ELSE 'NEUTRAL' END AS trend FROM (
 SELECT security_id, as_of, CASE WHEN count(*) >= 100 THEN avg(CASE WHEN rn <= 20 THEN px END) / avg(CASE WHEN rn <= 100 THEN px END) - 1 END AS trend_value,
 least(1, count(*) / 100) AS trend_complete FROM pts GROUP BY 1, 2)"""
VIEWS["rolled"] = """SELECT *, CASE WHEN row_number() OVER (PARTITION BY security_id, as_of ORDER BY ts) >= 20 THEN stddev_samp(ret) OVER (PARTITION BY security_id, as_of ORDER BY ts ROWS 18 PRECEDING) * sqrt(252.0::DOUBLE) END AS vol FROM pts"""
VIEWS["rg_vol"] = """SELECT security_id, as_of, cur AS volatility_value, complete AS volatility_complete, CASE WHEN complete < 0.75 OR n < 2 THEN 'UNKNOWN' WHEN share >= 0.95 THEN 'EXTREME' WHEN share >= 0.75 THEN 'HIGH'
 WHEN share <= 0.25 THEN 'LOW' ELSE 'NORMAL' END AS volatility FROM (SELECT security_id, as_of, max(c) AS cur, least(1, count(*) / 119) AS complete, count(vol) AS n,
 count(CASE WHEN rn <= 100 AND vol <= c THEN 1 END) / count(CASE WHEN rn <= 100 THEN vol END) AS share FROM (
 SELECT *, max(CASE WHEN rn = 1 THEN vol END) OVER (PARTITION BY security_id, as_of) AS c FROM rolled) GROUP BY 1, 2)"""
VIEWS["rg_liq"] = """SELECT *, CASE WHEN liquidity_value IS NULL THEN 'UNKNOWN' WHEN liquidity_value < 0.5 THEN 'LOW' WHEN liquidity_value > 1.5 THEN 'HIGH' ELSE 'NORMAL' END AS liquidity FROM (
 SELECT security_id, as_of, CASE WHEN count(*) >= 60 THEN avg(CASE WHEN rn <= 5 THEN volume END) / avg(CASE WHEN rn <= 60 THEN volume END) END AS liquidity_value FROM pts GROUP BY 1, 2)"""
VIEWS["rg_cor"] = """SELECT *, CASE WHEN correlation_value IS NULL THEN 'UNKNOWN' WHEN correlation_value >= 0.7 THEN 'HIGH' WHEN correlation_value <= 0.3 THEN 'LOW' ELSE 'NORMAL' END AS correlation FROM (
 SELECT security_id, as_of, CASE WHEN max(n) >= 61 THEN covar_pop(a, b) / sqrt(var_pop(CASE WHEN b IS NOT NULL THEN a END) * var_pop(b)) END AS correlation_value FROM (
 SELECT security_id, as_of, n, px / lag(px) OVER w - 1 AS a, bpx / lag(bpx) OVER w - 1 AS b FROM (
 SELECT p.security_id, p.as_of, p.ts, p.px, b.px AS bpx, count(*) OVER (PARTITION BY p.security_id, p.as_of) AS n, row_number() OVER (PARTITION BY p.security_id, p.as_of ORDER BY p.ts DESC) AS k
 FROM pts p JOIN bench_pts b ON p.as_of = b.as_of AND p.ts = b.ts) WHERE k <= 61 WINDOW w AS (PARTITION BY security_id, as_of ORDER BY ts)) GROUP BY 1, 2)"""
VIEWS["rg_stress"] = """SELECT security_id, as_of, stress_value, CASE WHEN volatility IN ('HIGH', 'EXTREME') AND stress_value <= -0.2 THEN 'HIGH'
 WHEN volatility IN ('HIGH', 'EXTREME') OR stress_value <= -0.1 THEN 'ELEVATED' ELSE 'NORMAL' END AS stress FROM (
 SELECT security_id, as_of, least(0, min(px / m - 1)) AS stress_value FROM (SELECT *, max(px) OVER (PARTITION BY security_id, as_of ORDER BY ts ROWS UNBOUNDED PRECEDING) AS m FROM pts WHERE rn <= 60) GROUP BY 1, 2)
 JOIN rg_vol USING (security_id, as_of)"""
VIEWS["rg_dist"] = """SELECT *, CASE WHEN distribution_value IS NULL THEN 'UNKNOWN' WHEN distribution_value >= 7 THEN 'HIGH' WHEN distribution_value >= 5 THEN 'ELEVATED' ELSE 'NORMAL' END AS distribution FROM (
 SELECT security_id, as_of, CASE WHEN count(*) >= 26 THEN count(CASE WHEN rn <= 25 AND ret <= -0.002 AND volume > v0 THEN 1 END) END AS distribution_value FROM (
 SELECT *, lag(volume) OVER (PARTITION BY security_id, as_of ORDER BY ts) AS v0 FROM pts) GROUP BY 1, 2)"""
VIEWS["rg_all"] = """SELECT *, CASE WHEN stress = 'HIGH' THEN 'HIGH_STRESS' WHEN trend IN ('BULL', 'BEAR') AND volatility = 'LOW' THEN trend || '_LOW_VOL'
 WHEN trend IN ('BULL', 'BEAR') AND volatility IN ('HIGH', 'EXTREME') THEN trend || '_HIGH_VOL' END AS label
 FROM rg_trend JOIN rg_vol USING (security_id, as_of) JOIN rg_liq USING (security_id, as_of) JOIN rg_cor USING (security_id, as_of) JOIN rg_stress USING (security_id, as_of) JOIN rg_dist USING (security_id, as_of)"""


def points(d: Domain):
    return rg.points_on_grid(d.bar_revisions, QUARTERS)


def composite(d: Domain):
    return rg.composite(d.bar_revisions, d.benchmark_bars, QUARTERS)


query("rgm_01_completeness", f"{K}, trend_complete:f", "SELECT * FROM rg_trend")(lambda d: rg.trend(points(d)))
query("rgm_02_realized_vol", f"{K}, vol:f", "SELECT security_id, as_of, stddev_samp(ret) * sqrt(252.0::DOUBLE) AS vol FROM pts GROUP BY 1, 2")(
    lambda d: points(d).groupBy(*rg.KEY).agg(sc.volatility("ret").alias("vol"))
)
query("rgm_03_rolling_vol", f"{K}, ts:t, vol:f", "SELECT * FROM rolled")(lambda d: rg.rolling_volatility(points(d)))
query("rgm_04_trend", f"{K}, trend:s, trend_value:f", "SELECT * FROM rg_trend")(lambda d: rg.trend(points(d)))
query("rgm_05_volatility", f"{K}, volatility:s, volatility_value:f, volatility_complete:f", "SELECT * FROM rg_vol")(lambda d: rg.volatility(points(d)))
query("rgm_06_liquidity", f"{K}, liquidity:s, liquidity_value:f", "SELECT * FROM rg_liq")(lambda d: rg.liquidity(points(d)))
query("rgm_07_correlation", f"{K}, correlation:s, correlation_value:f", "SELECT * FROM rg_cor")(
    lambda d: rg.correlation(points(d), rg.points_on_grid(d.benchmark_bars, QUARTERS))
)
query("rgm_08_stress", f"{K}, stress:s, stress_value:f", "SELECT * FROM rg_stress")(lambda d: rg.stress(points(d), rg.volatility(points(d))))
query("rgm_09_distribution_days", f"{K}, distribution:s, distribution_value:f", "SELECT * FROM rg_dist")(lambda d: rg.distribution_days(points(d)))
query("rgm_10_composite", f"{K}, trend:s, volatility:s, liquidity:s, correlation:s, stress:s, distribution:s, label:s", "SELECT * FROM rg_all")(composite)
query("rgm_11_label", "label:s, n:i", "SELECT label, count(*) AS n FROM rg_all GROUP BY 1")(lambda d: composite(d).groupBy("label").agg(F.count(F.lit(1)).alias("n")))
query("rgm_12_price_points", "security_id:s, ts:t, price:f, volume:f", "SELECT security_id, ts, coalesce(nullif(adjusted_close, 0), close) AS price, volume FROM bars")(
    lambda d: rg.price_points(d.bars)
)
query("rgm_13_level_points", "ts:t, price:f, volume:f", "SELECT ts, level AS price, NULL AS volume FROM benchmark_levels")(lambda d: rg.level_points(d.benchmark))

# ---- macro: dense series named like the inputs of the signals, derived from orders and bars ------------
VIEWS["macro_daily"] = """SELECT s.name AS series_id, o.d AS observation_date, CASE s.k WHEN 0 THEN v ELSE v - m END AS value, o.d AS realtime_start, NULL::TIMESTAMP AS realtime_end, o.d + INTERVAL 30 HOUR AS available_time FROM (
 SELECT o_orderdate AS d, round(sum(o_totalprice) / 1000000, 7) AS v FROM orders GROUP BY 1) o, (SELECT 2.0::DOUBLE AS m), (SELECT unnest(['LEVEL', 'SPREAD']) AS name, unnest([0, 1]) AS k) s
 UNION ALL SELECT 'CLAIMS', CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS w, round(sum(o_totalprice) / 1000000, 7), w + INTERVAL 7 DAY, NULL, w + INTERVAL 8 DAY + INTERVAL 6 HOUR FROM orders GROUP BY 2
 UNION ALL SELECT 'RATE', CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS w, round(sum(o_totalprice) / 10000000, 7), w + INTERVAL 35 DAY, NULL, w + INTERVAL 36 DAY + INTERVAL 6 HOUR FROM orders GROUP BY 2"""


def macro_daily(d: Domain):
    """LEVEL and SPREAD by day, CLAIMS by week, RATE by month, each with its own release lag."""
    o = d.table("orders")

    def one(name, day, scale, shift, lag_days):
        g = o.groupBy(day.alias("observation_date")).agg(F.round(F.sum("o_totalprice") / scale, 7).alias("value"))
        start = F.col("observation_date") + F.make_dt_interval(F.lit(lag_days))
        return g.select(
            F.lit(name).alias("series_id"), "observation_date", (F.col("value") - shift).alias("value"), start.alias("realtime_start"),
            F.lit(None).cast("timestamp").alias("realtime_end"), (start + F.make_dt_interval(F.lit(1), F.lit(6))).alias("available_time"),
        )

    day = F.col("o_orderdate")
    parts = [
        one("LEVEL", day, 1e6, 0.0, 0),
        one("SPREAD", day, 1e6, 2.0, 0),
        one("CLAIMS", F.date_trunc("week", day), 1e6, 0.0, 7),
        one("RATE", F.date_trunc("month", day), 1e7, 0.0, 35),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


VIEWS["mseries"] = """SELECT series_id, observation_date, as_of, value FROM (SELECT m.*, as_of, row_number() OVER (PARTITION BY series_id, observation_date, as_of ORDER BY realtime_start DESC) AS k
 FROM macro_daily m JOIN grid_q ON available_time <= as_of) WHERE k = 1 AND value IS NOT NULL"""


def mseries(d: Domain):
    return rd.series_on_grid(macro_daily(d), QUARTERS)


F_ = "as_of:t, flag:b"


def _win(series: str, days: int) -> str:
    return f"(SELECT * FROM mseries WHERE series_id = '{series}' AND observation_date >= as_of - INTERVAL {days} DAY)"


VIEWS["mac_vix"] = f"""SELECT as_of, CASE WHEN n >= 200 AND date_diff('day', d, as_of) <= 14 THEN last > p END AS flag, p FROM (
 SELECT as_of, count(*) AS n, max(observation_date) AS d, arg_max(value, observation_date) AS last, list_sort(list(value))[CAST(ceil(0.8::DOUBLE * count(*)) AS INT)] AS p FROM {_win('LEVEL', 365)} GROUP BY 1)"""
query("mac_01_level_high", F_, "SELECT * FROM mac_vix")(lambda d: mc.high_percentile(mseries(d), "LEVEL"))
query("mac_02_nearest_rank", "as_of:t, p:f", f"SELECT as_of, list_sort(list(value))[CAST(ceil(0.8::DOUBLE * count(*)) AS INT)] AS p FROM {_win('LEVEL', 365)} GROUP BY 1")(
    lambda d: mc._window(mseries(d), "LEVEL", 365).groupBy("as_of").agg(mc.nearest_rank(F.collect_list("value"), 0.8).alias("p"))
)
VIEWS["mac_below"] = f"SELECT as_of, arg_max(value, observation_date) < 0 AS flag FROM {_win('SPREAD', 14)} GROUP BY 1"
VIEWS["mac_above"] = f"SELECT as_of, arg_max(value, observation_date) > 0 AS flag FROM {_win('SPREAD', 30)} GROUP BY 1"
query("mac_03_below_zero", F_, "SELECT * FROM mac_below")(lambda d: mc.level_sign(mseries(d), "SPREAD", False, mc.DAILY))
query("mac_04_positive", F_, "SELECT * FROM mac_above")(lambda d: mc.level_sign(mseries(d), "SPREAD", True, mc.WEEKLY))


def _change_sql(series: str, test: str) -> str:
    return f"""SELECT l.as_of, CASE WHEN date_diff('day', max(d), l.as_of) <= 14 AND date_diff('day', max(w.observation_date), max(d) - INTERVAL 91 DAY) <= 14 THEN {test} END AS flag FROM (
 SELECT as_of, max(observation_date) AS d, arg_max(value, observation_date) AS latest FROM {_win(series, 119)} GROUP BY 1) l LEFT JOIN {_win(series, 119)} w ON w.as_of = l.as_of AND w.observation_date <= d - INTERVAL 91 DAY GROUP BY 1"""


_PRIOR = "arg_max(w.value, w.observation_date)"
VIEWS["mac_chg"] = _change_sql("LEVEL", f"max(latest) - {_PRIOR} > 1.0")
VIEWS["mac_rel"] = _change_sql("LEVEL", f"max(latest) / {_PRIOR} - 1 > 0.05")
query("mac_05_change_absolute", F_, "SELECT * FROM mac_chg")(lambda d: mc.change_above(mseries(d), "LEVEL", 1.0, False))
query("mac_05_change_relative", F_, "SELECT * FROM mac_rel")(lambda d: mc.change_above(mseries(d), "LEVEL", 0.05, True))
VIEWS["mac_sahm"] = f"""WITH mo AS (SELECT as_of, year(observation_date) * 12 + month(observation_date) AS m, arg_max(value, observation_date) AS v, max(observation_date) AS d FROM {_win('RATE', 620)} GROUP BY 1, 2),
 av AS (SELECT a.as_of, a.m, (SELECT avg(b.v) FROM mo b WHERE b.as_of = a.as_of AND b.m BETWEEN a.m - 2 AND a.m) AS mean, (SELECT count(*) FROM mo b WHERE b.as_of = a.as_of AND b.m BETWEEN a.m - 2 AND a.m) AS n FROM mo a),
 la AS (SELECT as_of, max(m) AS last, max(d) AS d FROM mo GROUP BY 1)
 SELECT av.as_of, CASE WHEN count(*) FILTER (WHERE n >= 2) = 13 AND date_diff('day', max(d), av.as_of) <= 100 THEN max(CASE WHEN m = last THEN mean END) - min(CASE WHEN m < last THEN mean END) END AS gap
 FROM av JOIN la ON av.as_of = la.as_of AND m BETWEEN last - 12 AND last GROUP BY 1"""
query("mac_06_sahm_rule", "as_of:t, gap:f, flag:b", "SELECT *, gap >= 0.5 AS flag FROM mac_sahm")(lambda d: mc.sahm(mseries(d), "RATE"))
VIEWS["mac_claims"] = f"""SELECT as_of, CASE WHEN count(*) >= 56 AND date_diff('day', max(observation_date), as_of) <= 30 THEN max(CASE WHEN k = 1 THEN mean END) / min(CASE WHEN k <= 52 THEN mean END) - 1 > 0.2 END AS flag FROM (
 SELECT *, CASE WHEN count(*) OVER w = 4 THEN avg(value) OVER w END AS mean FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY observation_date DESC) AS k FROM {_win('CLAIMS', 420)}) WHERE k <= 56
 WINDOW w AS (PARTITION BY as_of ORDER BY observation_date ROWS 3 PRECEDING)) GROUP BY 1"""
query("mac_07_claims_rise", F_, "SELECT * FROM mac_claims")(lambda d: mc.claims_rise(mseries(d), "CLAIMS"))
VIEWS["reg_pts"] = f"SELECT * FROM {panel_sql('region_revisions', 'grid_q', 140, None)}"
VIEWS["mac_gold"] = """SELECT as_of, CASE WHEN count(*) = 64 AND date_diff('day', max(ts), as_of) <= 14 THEN max(CASE WHEN k = 1 THEN a END) / max(CASE WHEN k = 64 THEN a END) > max(CASE WHEN k = 1 THEN b END) / max(CASE WHEN k = 64 THEN b END) END AS flag FROM (
 SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY ts DESC) AS k FROM (SELECT g.as_of, g.ts, g.px_null AS a, e.px_null AS b FROM reg_pts g JOIN reg_pts e ON g.as_of = e.as_of AND g.ts = e.ts
 WHERE g.security_id = 'ASIA' AND e.security_id = 'EUROPE' AND g.px_null > 0 AND e.px_null > 0)) WHERE k <= 64 GROUP BY 1"""


def gold(d: Domain):
    p = bar_panel(d.region_revisions, QUARTERS, 140, None)
    return mc.flight_to(p.filter(F.col("security_id") == "ASIA"), p.filter(F.col("security_id") == "EUROPE"))


query("mac_08_flight", F_, "SELECT * FROM mac_gold")(gold)


def moments(d: Domain):
    """The probe moments that see any macro value."""
    return mseries(d).select("as_of").distinct()


def macro_snapshot(d: Domain):
    s = mseries(d)
    return mc.snapshot(
        moments(d),
        {
            "level_high": mc.high_percentile(s, "LEVEL"),
            "inverted": mc.level_sign(s, "SPREAD", False, mc.DAILY),
            "shock": mc.change_above(s, "LEVEL", 1.0, False),
            "sahm": mc.sahm(s, "RATE"),
            "claims": mc.claims_rise(s, "CLAIMS"),
            "flight": gold(d),
        },
    )


VIEWS["msnap"] = """SELECT g.as_of, v.flag AS level_high, b.flag AS inverted, c.flag AS shock, s.gap >= 0.5 AS sahm, k.flag AS claims, o.flag AS flight FROM (SELECT DISTINCT as_of FROM mseries) g
 LEFT JOIN mac_vix v USING (as_of) LEFT JOIN mac_below b USING (as_of) LEFT JOIN mac_chg c USING (as_of) LEFT JOIN mac_sahm s USING (as_of) LEFT JOIN mac_claims k USING (as_of) LEFT JOIN mac_gold o USING (as_of)"""
SIGNALS = ("level_high", "inverted", "shock", "sahm", "claims", "flight")
query("mac_09_snapshot", "as_of:t, " + ", ".join(f"{s}:b" for s in SIGNALS), "SELECT * FROM msnap")(macro_snapshot)
_ACTIVE = " + ".join(f"CAST(coalesce({s}, FALSE) AS INT)" for s in SIGNALS)
query(
    "mac_10_exposure",
    "as_of:t, combined:f, single:f",
    f"SELECT as_of, [1.0, 1.0, 0.75, 0.5][least({_ACTIVE}, 3) + 1] AS combined, CASE WHEN coalesce(shock, FALSE) THEN 0.5 ELSE 1 END AS single FROM msnap",
)(lambda d: macro_snapshot(d).select("as_of", mc.exposure(SIGNALS).alias("combined"), mc.exposure(("shock",)).alias("single")))
query(
    "mac_11_pass_rule",
    "grp:s, passed:b",
    "SELECT p.grp, p.max_drawdown - b.d >= 0.15 AND p.sharpe >= b.s AND b.c - p.cagr <= 0.015 AS passed FROM perf p, (SELECT min(max_drawdown) - 0.14 AS d, avg(sharpe) AS s, avg(cagr) AS c FROM perf) b",
)(
    lambda d: sg.attach(
        pf.performance_report(nav(d)),
        pf.performance_report(nav(d)).agg((F.min("max_drawdown") - 0.14).alias("d0"), F.avg("sharpe").alias("s0"), F.avg("cagr").alias("c0")),
    ).select("grp", mc.passes(F.col("max_drawdown"), F.col("sharpe"), F.col("cagr"), F.col("d0"), F.col("s0"), F.col("c0")).alias("passed"))
)
query(
    "agg_33_exposure_stats",
    "mean_exposure:f, reduced_share:f, changes:i",
    f"""SELECT avg(e) AS mean_exposure, avg(CAST(e < 1 AS INT)) AS reduced_share, count(*) FILTER (WHERE e <> p) AS changes FROM (SELECT e, lag(e) OVER (ORDER BY as_of) AS p FROM (
 SELECT as_of, [1.0, 1.0, 0.75, 0.5][least({_ACTIVE}, 3) + 1] AS e FROM msnap))""",
)(lambda d: exposure_stats(macro_snapshot(d).select("as_of", mc.exposure(SIGNALS).alias("e"))))


def exposure_stats(log):
    """Mean exposure, share of reduced moments, number of changes; one row per moment."""
    from pyspark.sql import Window

    moved = log.withColumn("p", F.lag("e").over(Window.orderBy("as_of")))
    return moved.agg(
        F.avg("e").alias("mean_exposure"), F.avg((F.col("e") < 1).cast("double")).alias("reduced_share"), F.count_if(F.col("e") != F.col("p")).alias("changes")
    )


query(
    "agg_34_signal_availability",
    "signal:s, available:f, first_seen:t, active:f",
    """SELECT signal, count(v) / count(*) AS available, min(CASE WHEN v IS NOT NULL THEN as_of END) AS first_seen, avg(CAST(v AS INT)) AS active FROM (
 SELECT as_of, unnest(['level_high', 'inverted', 'shock', 'sahm', 'claims', 'flight']) AS signal, unnest([level_high, inverted, shock, sahm, claims, flight]) AS v FROM msnap) GROUP BY 1""",
)(
    lambda d: macro_snapshot(d)
    .unpivot(["as_of"], list(SIGNALS), "signal", "v")
    .groupBy("signal")
    .agg(
        (F.count("v") / F.count(F.lit(1))).alias("available"),
        F.min(F.when(F.col("v").isNotNull(), F.col("as_of"))).alias("first_seen"),
        F.avg(F.col("v").cast("int").cast("double")).alias("active"),
    )
)

# ---- decision cascades over a book derived from orders ----------------------------------------------------
VIEWS["book"] = """SELECT o_orderkey AS decision_id, o_orderdate AS decision_time, 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS security_id,
 CASE WHEN o_orderkey % 13 <> 0 THEN round((o_orderkey % 41 - 20) / 1000, 4) END AS expected_return, round(o_orderkey % 7 / 500, 4) AS uncertainty, round(0.6::DOUBLE + 0.4::DOUBLE * (o_totalprice / 600000.0::DOUBLE), 4) AS confidence,
 CASE WHEN o_custkey % 11 <> 0 THEN round(o_custkey % 90 / 100, 4) END AS expected_volatility, ['UNKNOWN', 'BULL', 'BEAR', 'NEUTRAL', 'BULL', 'BULL', 'BEAR', 'BULL', 'NEUTRAL'][o_custkey % 9 + 1] AS trend,
 ['NORMAL', 'HIGH', 'NORMAL', 'UNKNOWN', 'ELEVATED', 'NORMAL', 'NORMAL', 'NORMAL'][o_orderkey % 8 + 1] AS stress, ['LOW', 'NORMAL', 'UNKNOWN', 'HIGH', 'NORMAL', 'NORMAL'][o_orderkey % 6 + 1] AS liquidity,
 CASE WHEN o_orderkey % 4 = 0 THEN 10.0 ELSE 0.0 END AS quantity, c_acctbal AS cash, c_acctbal + 2000 * (o_custkey % 5) AS portfolio_value, 20.0 + o_orderkey % 50 AS price,
 round(o_custkey % 12 / 10, 2) AS gross, CASE WHEN o_custkey % 10 <> 0 THEN -round(o_custkey % 30 / 100, 3) END AS drawdown, CASE WHEN o_custkey % 17 <> 0 THEN round(o_custkey % 40 / 100, 3) END AS portfolio_volatility,
 round(o_custkey % 20 / 10, 2) AS turnover, CASE WHEN o_custkey % 6 <> 0 THEN 'S' || CAST(o_custkey % 5 AS VARCHAR) END AS sector, round(o_custkey % 4 / 10, 2) AS sector_exposure,
 o_orderdate - (o_orderkey % 20) * INTERVAL 1 DAY AS last_exit FROM orders JOIN customer ON c_custkey = o_custkey"""


def book(d: Domain):
    """One row per order with a prediction, regime states and the state of its portfolio."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def pick(values, i):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))

    o = d.table("orders").join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        k.alias("decision_id"),
        F.col("o_orderdate").alias("decision_time"),
        F.concat(F.lit("Brand#"), (c % 25 + 1).cast("string")).alias("security_id"),
        F.when(k % 13 != 0, F.round((k % 41 - 20) / 1000, 4)).alias("expected_return"),
        F.round(k % 7 / 500, 4).alias("uncertainty"),
        F.round(F.lit(0.6) + F.lit(0.4) * (F.col("o_totalprice") / 600000.0), 4).alias("confidence"),
        F.when(c % 11 != 0, F.round(c % 90 / 100, 4)).alias("expected_volatility"),
        pick(["UNKNOWN", "BULL", "BEAR", "NEUTRAL", "BULL", "BULL", "BEAR", "BULL", "NEUTRAL"], c % 9).alias("trend"),
        pick(["NORMAL", "HIGH", "NORMAL", "UNKNOWN", "ELEVATED", "NORMAL", "NORMAL", "NORMAL"], k % 8).alias("stress"),
        pick(["LOW", "NORMAL", "UNKNOWN", "HIGH", "NORMAL", "NORMAL"], k % 6).alias("liquidity"),
        F.when(k % 4 == 0, 10.0).otherwise(0.0).alias("quantity"),
        F.col("c_acctbal").alias("cash"),
        (F.col("c_acctbal") + 2000 * (c % 5)).alias("portfolio_value"),
        (F.lit(20.0) + k % 50).alias("price"),
        F.round(c % 12 / 10, 2).alias("gross"),
        F.when(c % 10 != 0, -F.round(c % 30 / 100, 3)).alias("drawdown"),
        F.when(c % 17 != 0, F.round(c % 40 / 100, 3)).alias("portfolio_volatility"),
        F.round(c % 20 / 10, 2).alias("turnover"),
        F.when(c % 6 != 0, F.concat(F.lit("S"), (c % 5).cast("string"))).alias("sector"),
        F.round(c % 4 / 10, 2).alias("sector_exposure"),
        (F.col("o_orderdate") - F.make_dt_interval((k % 20).cast("int"))).alias("last_exit"),
    )


VIEWS["decided"] = """SELECT *, CASE reason WHEN 'already_positioned_positive_signal' THEN 'HOLD' WHEN 'positive_expected_return_above_threshold' THEN 'BUY' WHEN 'negative_expected_return_below_threshold' THEN 'SELL' ELSE 'NO_TRADE' END AS act FROM (
 SELECT *, CASE WHEN expected_return IS NULL THEN 'prediction_unavailable' WHEN confidence < 0.75 THEN 'confidence_below_threshold' WHEN abs(expected_return) <= uncertainty THEN 'uncertainty_exceeds_signal'
 WHEN trend = 'UNKNOWN' THEN 'regime_trend_unknown' WHEN stress = 'UNKNOWN' THEN 'regime_stress_unknown' WHEN stress = 'HIGH' THEN 'regime_stress_high'
 WHEN expected_return >= 0.005 THEN CASE WHEN quantity > 0 THEN 'already_positioned_positive_signal' ELSE 'positive_expected_return_above_threshold' END
 WHEN expected_return <= -0.005 THEN CASE WHEN quantity > 0 THEN 'negative_expected_return_below_threshold' ELSE 'negative_signal_no_position_to_exit' END ELSE 'expected_return_below_threshold' END AS reason FROM book)"""
VIEWS["sized"] = """SELECT *, split_part(rule, ':', 1) AS size_status, split_part(rule, ':', 2) AS size_reason, CASE WHEN rule LIKE 'REJECT%' THEN 0 WHEN act = 'BUY' AND rule NOT LIKE 'UNKNOWN%' THEN lots * price / portfolio_value END AS target_weight FROM (
 SELECT *, CASE WHEN act IN ('HOLD', 'NO_TRADE') THEN 'PASS:no_new_sizing_for_' || lower(act) WHEN portfolio_value <= 0 THEN 'UNKNOWN:invalid_portfolio_value' WHEN act = 'SELL' THEN 'PASS:full_exit'
 WHEN quantity <> 0 THEN 'UNKNOWN:unexpected_existing_position_for_buy' WHEN confidence > 1 THEN 'UNKNOWN:invalid_confidence' WHEN expected_volatility IS NULL THEN 'REJECT:volatility_unavailable'
 WHEN expected_volatility >= 0.8 THEN 'REJECT:volatility_exceeds_limit' WHEN liquidity = 'UNKNOWN' THEN 'REJECT:liquidity_unknown' WHEN lots <= 0 THEN 'REJECT:sized_to_zero'
 WHEN bound < base - 1e-12 AND by_cash <= 0.1 THEN 'REDUCE:cash_shortage' WHEN bound < base - 1e-12 THEN 'REDUCE:risk_budget_exceeded' ELSE 'PASS:normal_sizing' END AS rule FROM (
 SELECT *, floor(bound * portfolio_value / price) AS lots FROM (SELECT *, least(base, by_cash, 0.1::DOUBLE) AS bound FROM (
 SELECT *, 0.1::DOUBLE * confidence * CASE WHEN expected_volatility > 0.2 THEN greatest(0.1::DOUBLE, 0.2::DOUBLE / expected_volatility) ELSE 1 END * CASE WHEN liquidity = 'LOW' THEN 0.5::DOUBLE ELSE 1 END AS base,
 greatest(0, cash * (1 - 0.02::DOUBLE)) / nullif(portfolio_value, 0) AS by_cash FROM decided))))"""


def _assess_sql(gross: float, drawdown: float, vol: float, sector: float | None) -> str:
    """The cascade for the limits used below: cash, gross, drawdown, volatility, sector and liquidity."""
    sec_no = f"WHEN sector IS NULL THEN 'sector_unknown' WHEN sector_exposure + w2 > {sector} AND {sector}::DOUBLE - sector_exposure <= 0 THEN 'sector_limit_breached'" if sector else ""
    sec_w = f"CASE WHEN sector_exposure + w2 > {sector} THEN least(w2, {sector}::DOUBLE - sector_exposure) ELSE w2 END" if sector else "w2"
    sec_h = f"CASE WHEN sector_exposure + w2 > {sector} THEN 'sector_limit' END" if sector else "NULL"
    return f"""SELECT *, CASE WHEN act <> 'BUY' OR size_status NOT IN ('PASS', 'REDUCE') THEN CASE WHEN portfolio_value <= 0 THEN 'UNKNOWN:invalid_portfolio_value' WHEN size_status IN ('UNKNOWN', 'REJECT') THEN rule ELSE 'PASS:no_new_risk_limit_applicable' END
 WHEN fail IS NOT NULL THEN 'REJECT:' || fail WHEN w3 <= 0 THEN 'REJECT:sized_to_zero_by_risk_checks' WHEN coalesce(h3, h2, h1) IS NOT NULL THEN 'REDUCE:' || coalesce(h3, h2, h1) ELSE 'PASS:risk_checks_passed' END AS verdict FROM (
 SELECT *, {sec_w} AS w3, {sec_h} AS h3, CASE WHEN spare <= 0 AND h1 IS NOT NULL THEN 'cash_minimum_breach' WHEN h2 IS NOT NULL AND {gross}::DOUBLE - gross <= 0 THEN 'gross_exposure_limit_breached'
 WHEN drawdown IS NULL THEN 'drawdown_unknown' WHEN abs(drawdown) >= {drawdown} THEN 'drawdown_limit_breached' WHEN portfolio_volatility IS NULL THEN 'portfolio_volatility_unknown' WHEN portfolio_volatility > {vol} THEN 'portfolio_volatility_limit_breached'
 {sec_no} WHEN liquidity = 'LOW' THEN 'liquidity_limit_breached' END AS fail FROM (
 SELECT *, CASE WHEN h2 IS NOT NULL THEN least(w1, greatest(0, {gross}::DOUBLE - gross)) ELSE w1 END AS w2 FROM (SELECT *, CASE WHEN gross + w1 > {gross} THEN 'gross_exposure' END AS h2 FROM (
 SELECT *, CASE WHEN h1 IS NOT NULL THEN least(target_weight, spare) ELSE target_weight END AS w1 FROM (
 SELECT *, greatest(0, cash - 0.05::DOUBLE * portfolio_value) / nullif(portfolio_value, 0) AS spare, CASE WHEN (cash - target_weight * portfolio_value) / nullif(portfolio_value, 0) < 0.05 THEN 'cash_minimum' END AS h1 FROM sized)))))"""


REAL, SHADOW = sc.RiskLimits(), sc.RiskLimits(max_gross=0.8, max_drawdown=0.15, max_sector=0.25)
VIEWS["assessed"] = _assess_sql(1.0, 0.2, 0.3, None)
VIEWS["assessed_shadow"] = _assess_sql(0.8, 0.15, 0.3, 0.25)
query("dec_01_random_walk", "security_id:s, as_of:t, expected_return:f, probability:f, confidence:f", "SELECT DISTINCT security_id, as_of, 0 AS expected_return, 0.5 AS probability, 1 AS confidence FROM pts")(
    lambda d: sc.random_walk(points(d).select("security_id", "as_of").distinct())
)
VIEWS["drift"] = f"""SELECT security_id, as_of, least(1, n / 61) AS confidence, CASE WHEN ok THEN pow(1 + m, 5) - 1 END AS expected_return, CASE WHEN ok THEN p END AS probability, CASE WHEN ok THEN sd * sqrt(252.0::DOUBLE) END AS expected_volatility,
 CASE WHEN ok THEN sd / sqrt(k) END AS uncertainty FROM (SELECT security_id, as_of, count(*) AS n, count(r) AS k, avg(r) AS m, avg(CASE WHEN r IS NOT NULL THEN CAST(r > 0 AS INT) END) AS p, stddev_samp(r) AS sd, least(1, count(*) / 61) >= 0.75 AND count(r) >= 2 AS ok FROM (
 SELECT *, CASE WHEN lag(px_null) OVER k <> 0 THEN px_null / lag(px_null) OVER k - 1 END AS r FROM {panel_sql('bar_revisions', 'grid_q', 120, None)} WINDOW k AS (PARTITION BY security_id, as_of ORDER BY ts)) GROUP BY 1, 2)"""
DR = "security_id:s, as_of:t, expected_return:f, probability:f, expected_volatility:f, uncertainty:f, confidence:f"
query("dec_02_drift", DR, "SELECT * FROM drift")(lambda d: sc.drift(d.bar_revisions, QUARTERS))
query(
    "dec_03_regime_aware",
    "security_id:s, as_of:t, expected_return:f, confidence:f",
    """SELECT security_id, as_of, expected_return * s AS expected_return, confidence * s AS confidence FROM (SELECT d.*, CASE WHEN volatility = 'EXTREME' AND expected_return IS NOT NULL THEN 0.5::DOUBLE ELSE 1 END AS s
 FROM drift d LEFT JOIN rg_vol USING (security_id, as_of))""",
)(lambda d: sc.regime_aware(sc.drift(d.bar_revisions, QUARTERS), rg.volatility(points(d))))
query("dec_04_decide", "decision_id:i, decision_action:s, decision_reason:s", "SELECT decision_id, act AS decision_action, reason AS decision_reason FROM decided")(lambda d: sc.decide(book(d)))
query("dec_05_size", "decision_id:i, size_status:s, size_reason:s, target_weight:f", "SELECT * FROM sized")(lambda d: sc.size(sc.decide(book(d))))
query("dec_07_assess", "decision_id:i, verdict:s", "SELECT decision_id, verdict FROM assessed")(
    lambda d: sc.assess(sc.size(sc.decide(book(d))), REAL).select("decision_id", F.concat_ws(":", "risk_status", "risk_reason").alias("verdict"))
)
query(
    "dec_08_shadow",
    "decision_id:i, real_status:s, shadow_status:s, shadow_reason:s, diverged:b",
    """SELECT a.decision_id, split_part(a.verdict, ':', 1) AS real_status, split_part(b.verdict, ':', 1) AS shadow_status, split_part(b.verdict, ':', 2) AS shadow_reason, split_part(a.verdict, ':', 1) <> split_part(b.verdict, ':', 1) AS diverged
 FROM assessed a JOIN assessed_shadow b USING (decision_id)""",
)(lambda d: sc.shadow(sc.size(sc.decide(book(d))), REAL, SHADOW))


def valued(d: Domain):
    p = positions(d).filter(F.col("cash") > 0).join(d.sector, "security_id")
    return p.select("portfolio", "security_id", "sector", (F.col("quantity") * F.col("average_cost")).alias("market_value"), (F.col("cash") * 100).alias("portfolio_value"))


query(
    "dec_06_risk_state",
    "portfolio:i, gross:f, concentration:f, positions:i, top_sector:f, budget_usage:f",
    """SELECT portfolio, sum(w) AS gross, max(w) AS concentration, count(*) AS positions, max(sw) AS top_sector, sum(w) AS budget_usage FROM (
 SELECT *, sum(w) OVER (PARTITION BY portfolio, sector) AS sw FROM (SELECT portfolio, sector, quantity * average_cost / (cash * 100) AS w FROM positions JOIN sector USING (security_id) WHERE cash > 0) WHERE w <> 0) GROUP BY 1""",
)(lambda d: sc.risk_state(valued(d)))
_T = "SELECT trade_id, quantity AS q, fill_price AS p, CASE WHEN trade_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, trade_id % 3000 AS v FROM trades"


def _trades(d: Domain):
    k = F.col("trade_id")
    return d.trades.select("trade_id", F.col("quantity").alias("q"), F.col("fill_price").alias("p"), F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), (k % 3000).alias("v"))


_q, _p, _s, _v = (lambda: F.col("q")), (lambda: F.col("p")), (lambda: F.col("side")), (lambda: F.col("v"))
for _no, _nm, _fn, _e in (
    ("09", "commission", lambda: sc.commission(_q()), "1.0::DOUBLE + 0.005::DOUBLE * q"),
    ("10", "spread_price", lambda: sc.spread_price(_p(), _s()), "CASE side WHEN 'BUY' THEN p + p * 0.0001::DOUBLE ELSE p - p * 0.0001::DOUBLE END"),
    ("11", "fixed_slippage", lambda: sc.fixed_slippage(_p(), _s()), "CASE side WHEN 'BUY' THEN p + p * 0.0005::DOUBLE ELSE p - p * 0.0005::DOUBLE END"),
    (
        "12",
        "volume_slippage",
        lambda: sc.volume_slippage(_p(), _q(), _s(), _v()),
        "p + CASE side WHEN 'BUY' THEN 1 ELSE -1 END * (p * ((5 + 100 * CASE WHEN v > 0 THEN q / v ELSE 0 END) / 10000))",
    ),
):
    query(f"dec_{_no}_{_nm}", "trade_id:i, cost:f8", f"SELECT trade_id, {_e} AS cost FROM ({_T})")(lambda d, f=_fn: _trades(d).select("trade_id", f().alias("cost")))
query(
    "dec_13_rank_average_top",
    "security_id:s, as_of:t, combined:f, place:i",
    f"""SELECT * FROM (SELECT security_id, as_of, combined, row_number() OVER (PARTITION BY as_of ORDER BY combined DESC, security_id) AS place FROM (
 SELECT security_id, as_of, (rank() OVER (PARTITION BY as_of ORDER BY a) + (count(*) OVER (PARTITION BY as_of, a) - 1) / 2.0::DOUBLE + rank() OVER (PARTITION BY as_of ORDER BY b) + (count(*) OVER (PARTITION BY as_of, b) - 1) / 2.0::DOUBLE) / 2 AS combined
 FROM (SELECT security_id, as_of, {FACT_SQL['leverage']} AS a, {FACT_SQL['net_margin']} AS b FROM fyp) WHERE a IS NOT NULL AND b IS NOT NULL)) WHERE place <= 5""",
)(lambda d: sc.rank_average_top(_two_scores(d), ["leverage", "net_margin"], 5))


def _two_scores(d: Domain):
    from tidemark.operators.fundamental_factors import fact_scores

    return fact_scores(d.fundamentals, QUARTERS, ["leverage", "net_margin"])


_MV = f"""SELECT a.security_id, a.as_of, a.score, b.vol FROM (SELECT security_id, as_of, CASE WHEN count(*) >= 2 THEN arg_max(px, ts) / arg_min(px, ts) - 1 END AS score FROM {panel_sql('bar_revisions', 'grid_q', 504, 253)} GROUP BY 1, 2) a
 LEFT JOIN (SELECT security_id, as_of, stddev_samp(ret) * sqrt(252.0::DOUBLE) AS vol FROM {panel_sql('bar_revisions', 'grid_q', 144, 91)} GROUP BY 1, 2) b USING (security_id, as_of)"""


def _momentum_vol(d: Domain):
    both = px.score_factors(d.bar_revisions, QUARTERS, ["long_term_momentum", "realized_vol_90"])
    return both.select("security_id", "as_of", F.round("long_term_momentum", 10).alias("score"), F.col("realized_vol_90").alias("vol"))


query(
    "dec_14_inverse_vol_weights",
    "security_id:s, as_of:t, place:i, weight:f",
    f"""SELECT security_id, as_of, place, least(i / sum(i) OVER (PARTITION BY as_of), 0.2::DOUBLE) AS weight FROM (SELECT *, coalesce(1 / greatest(vol, 0.01::DOUBLE), 0) AS i, row_number() OVER (PARTITION BY as_of ORDER BY round(score, 10) DESC, security_id) AS place
 FROM ({_MV}) WHERE score IS NOT NULL) WHERE place <= 5""",
)(lambda d: sc.inverse_volatility_weights(_momentum_vol(d)))
query(
    "dec_15_top_n_returns",
    "as_of:t, gross:f, turnover:f, net:f",
    f"""WITH held AS (SELECT security_id, as_of, 1.0::DOUBLE / count(*) OVER (PARTITION BY as_of) AS w FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY round(score, 10) DESC, security_id) AS k FROM ({_MV}) WHERE score IS NOT NULL) WHERE k <= 5),
 nxt AS (SELECT as_of, lead(as_of) OVER (ORDER BY as_of) AS n FROM (SELECT DISTINCT as_of FROM held)),
 tv AS (SELECT as_of, sum(abs(coalesce(w, 0) - coalesce(w0, 0))) AS turnover FROM held FULL JOIN (SELECT security_id, n AS as_of, w AS w0 FROM held JOIN nxt USING (as_of) WHERE n IS NOT NULL) USING (security_id, as_of) GROUP BY 1)
 SELECT as_of, gross, turnover, gross - turnover * 0.001::DOUBLE AS net FROM (SELECT h.as_of, sum(w * coalesce(fwd, 0)) AS gross FROM held h LEFT JOIN {forward_sql('bar_revisions', 'grid_q', 60)} f USING (security_id, as_of) GROUP BY 1) JOIN tv USING (as_of)""",
)(lambda d: sc.top_n_returns(_momentum_vol(d), sg.forward_return(d.bar_revisions, QUARTERS, 60), 5, 0.001))
