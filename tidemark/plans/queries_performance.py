"""Performance of value series: one series per brand, the closing price as its value."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import average_rank, fallback_null
from tidemark.operators import performance as pf
from tidemark.operators import signals as sg
from tidemark.plans.domain import QUARTERS, Domain
from tidemark.plans.oracle import VIEWS, forward_sql
from tidemark.plans.registry import query

VIEWS["nav"] = "SELECT security_id AS grp, ts, close AS value FROM bars"
VIEWS["path"] = """SELECT *, (value - peak) / peak AS dd FROM (SELECT *, value / lag(value) OVER w - 1 AS ret, max(value) OVER (PARTITION BY grp ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak
 FROM nav WINDOW w AS (PARTITION BY grp ORDER BY ts))"""
_YEARS = "(date_diff('day', min(ts), max(ts)) / 365.25::DOUBLE)"
VIEWS["perf"] = f"""SELECT grp, count(*) AS n, arg_min(value, ts) AS first_v, arg_max(value, ts) AS last_v, min(ts) AS t0, max(ts) AS t1,
 arg_max(value, ts) / arg_min(value, ts) - 1 AS cumulative, pow(arg_max(value, ts) / arg_min(value, ts), 1 / {_YEARS}) - 1 AS cagr,
 stddev_samp(ret) * sqrt(252.0::DOUBLE) AS volatility, avg(ret) / stddev_samp(ret) * sqrt(252.0::DOUBLE) AS sharpe,
 avg(ret) / sqrt(avg(pow(least(0, ret), 2))) * sqrt(252.0::DOUBLE) AS sortino, min(dd) AS max_drawdown, sqrt(avg(dd * dd)) AS ulcer,
 quantile_cont(ret, 0.05) AS var FROM path GROUP BY 1"""
VIEWS["tail"] = "SELECT p.grp, max(f.var) AS var, avg(ret) AS cvar FROM path p JOIN perf f ON p.grp = f.grp AND ret <= f.var GROUP BY 1"
VIEWS["episodes"] = """SELECT *, (low - peak_value) / peak_value AS depth, date_diff('day', peak_time, trough_time) AS days_to_trough, date_diff('day', trough_time, recovery_time) AS recovery_days FROM (
 SELECT *, lead(peak_time) OVER (PARTITION BY grp ORDER BY peak_time) AS recovery_time FROM (
 SELECT grp, island, min(ts) AS peak_time, arg_min(value, ts) AS peak_value, min(value) AS low, min(CASE WHEN value = m THEN ts END) AS trough_time, count(*) AS n FROM (
 SELECT *, min(value) OVER (PARTITION BY grp, island) AS m FROM (
 SELECT *, sum(CASE WHEN b IS NULL OR value >= b THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY ts) AS island FROM (
 SELECT *, max(value) OVER (PARTITION BY grp ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM nav))) GROUP BY 1, 2)) WHERE n > 1"""


def nav(d: Domain):
    return d.bars.select(F.col("security_id").alias("grp"), "ts", F.col("close").alias("value"))


def q(name, cols, sql=None):
    return query(name, cols, sql)


q("win_01_returns", "grp:s, ts:t, ret:f", "SELECT grp, ts, ret FROM path WHERE ret IS NOT NULL")(lambda d: pf.returns(nav(d)))


def _metric(key: str, column: str, expr):
    q(key, f"grp:s, {column}:f", f"SELECT grp, {column} FROM perf")(lambda d: pf.with_path(nav(d)).groupBy("grp").agg(expr().alias(column)))


_metric("win_02_max_drawdown", "max_drawdown", pf.max_drawdown)
_metric("win_03_volatility", "volatility", pf.volatility0)
_metric("win_04_sharpe", "sharpe", pf.sharpe)
_metric("win_05_sortino", "sortino", pf.sortino)
_metric("win_06_cagr", "cagr", lambda: pf.cagr(F.min_by("value", "ts"), F.max_by("value", "ts"), F.min("ts"), F.max("ts")))
_metric("win_08_ulcer", "ulcer", pf.ulcer)
_metric("win_09_value_at_risk", "var", pf.value_at_risk)
q("win_07_calmar", "grp:s, calmar:f", "SELECT grp, cagr / abs(max_drawdown) AS calmar FROM perf")(lambda d: pf.performance_report(nav(d)))
q("win_10_conditional_var", "grp:s, var:f, cvar:f", "SELECT * FROM tail")(lambda d: pf.conditional_value_at_risk(nav(d)))
q(
    "win_11_drawdown_episodes",
    "grp:s, peak_time:t, trough_time:t, recovery_time:t, depth:f, days_to_trough:i, recovery_days:i",
    "SELECT * FROM episodes",
)(lambda d: pf.drawdown_episodes(nav(d)))
_WORST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY depth, peak_time) AS k FROM episodes) WHERE k = 1"
q("win_12_worst_episode", "grp:s, peak_time:t, trough_time:t, depth:f", _WORST)(lambda d: pf.worst_episode(pf.drawdown_episodes(nav(d))))
_REPORT = f"""SELECT p.*, cagr / abs(max_drawdown) AS calmar, cvar, days_to_trough, recovery_days, recovery_time IS NULL AS underwater
 FROM perf p LEFT JOIN tail USING (grp) LEFT JOIN ({_WORST}) w ON w.grp = p.grp"""
_RCOLS = "grp:s, cumulative:f, cagr:f, volatility:f, sharpe:f, sortino:f, max_drawdown:f, calmar:f, ulcer:f, var:f, cvar:f, days_to_trough:i, recovery_days:i, underwater:b"
q("win_13_performance_report", _RCOLS, _REPORT)(lambda d: pf.performance_report(nav(d)))


def year_nav(d: Domain):
    """Short series: one per brand and part of a month; the first five parts have four days, the last one the rest."""
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / 4), F.lit(5)).cast("string")
    return d.bars.select(F.concat_ws("@", "security_id", F.date_format("ts", "yyyy-MM"), part).alias("grp"), "ts", F.col("close").alias("value"))


q(
    "win_14_session_report",
    "grp:s, n:i, volatility:f, volatility_reason:s, sharpe:f3, calmar_reason:s",
    """SELECT grp, n, CASE WHEN n >= 5 THEN coalesce(v, 0) END AS volatility, CASE WHEN n < 5 THEN 'insufficient_data' END AS volatility_reason,
 CASE WHEN n >= 5 AND v > 0 THEN m / v * 252 END AS sharpe, CASE WHEN n < 2 THEN 'insufficient_data' WHEN coalesce(mdd, 0) = 0 THEN 'zero_drawdown' END AS calmar_reason FROM (
 SELECT grp, count(*) AS n, stddev_samp(ret) * sqrt(252.0::DOUBLE) AS v, avg(ret) AS m, min((value - peak) / peak) AS mdd FROM (
 SELECT *, value / lag(value) OVER w - 1 AS ret, max(value) OVER (PARTITION BY grp ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM (
 SELECT security_id || '@' || strftime(ts, '%Y-%m') || '@' || CAST(least((day(ts) - 1) // 4, 5) AS VARCHAR) AS grp, ts, close AS value FROM bars) WINDOW w AS (PARTITION BY grp ORDER BY ts)) GROUP BY 1)""",
)(lambda d: pf.session_report(year_nav(d)))
_FEE, _HS, _CAP = 1.0, 0.0005, 10000.0
q(
    "win_15_benchmark_nav",
    "start_day:t, end_day:t, final_value:f, cumulative:f, cagr:f, max_drawdown:f",
    f"""SELECT start AS start_day, fin AS end_day, final_value, final_value / {_CAP} - 1 AS cumulative, pow(final_value / {_CAP}, 365.25::DOUBLE / date_diff('day', start, fin)) - 1 AS cagr, max_drawdown FROM (
 SELECT min(ts) AS start, max(ts) AS fin, ({_CAP} - {_FEE}) / (arg_min(level, ts) * (1 + {_HS}::DOUBLE)) * arg_max(level, ts) * (1 - {_HS}::DOUBLE) - {_FEE} AS final_value, min(level / peak - 1) AS max_drawdown FROM (
 SELECT *, max(level) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM benchmark_levels))""",
)(lambda d: pf.benchmark_nav(d.benchmark, _CAP, _FEE, _HS).withColumnsRenamed({"start": "start_day", "end": "end_day"}))
q(
    "win_16_total_return",
    "security_id:s, ts:t, log_level:f4, available_time:t",
    """SELECT security_id, ts, ln(100.0::DOUBLE) + sum(CASE WHEN prev > 0 THEN ln((close * coalesce(split, 1) + coalesce(dividend, 0)) / prev) ELSE 0 END) OVER w AS log_level,
 max(greatest(available_time, coalesce(known, available_time))) OVER w AS available_time FROM (
 SELECT b.*, split, dividend, known, lag(close) OVER (PARTITION BY b.security_id ORDER BY b.ts) AS prev FROM bars b LEFT JOIN (
 SELECT a.security_id, CAST(date_trunc('day', coalesce(effective_time, event_time)) AS TIMESTAMP) AS ts, sum(CASE WHEN action_type = 'CASH_DIVIDEND' THEN amount END) AS dividend, max(available_time) AS known,
 exp(sum(ln(CASE WHEN action_type = 'CASH_DIVIDEND' THEN NULL WHEN contains(ratio_text, ':') THEN CAST(split_part(ratio_text, ':', 1) AS DOUBLE) / CAST(split_part(ratio_text, ':', 2) AS DOUBLE) ELSE CAST(ratio_text AS DOUBLE) END))) AS split
 FROM actions a GROUP BY 1, 2) x USING (security_id, ts)) WINDOW w AS (PARTITION BY security_id ORDER BY ts)""",
)(lambda d: pf.total_return_levels(d.bars, d.actions))


def priced(d: Domain):
    return d.bars.withColumn("px_null", fallback_null("adjusted_close", "close"))


VIEWS["month_ends"] = """SELECT security_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, arg_max(coalesce(adjusted_close, close), ts) AS price
 FROM bars WHERE coalesce(adjusted_close, close) > 0 GROUP BY 1, 2"""
q("win_17_month_end_closes", "security_id:s, month:t, price:f", "SELECT * FROM month_ends")(lambda d: pf.month_ends(priced(d)))
q(
    "win_18_sma_exposure",
    "security_id:s, month:t, exposure:f",
    """SELECT security_id, month, CASE WHEN count(*) OVER w = 10 THEN CASE WHEN price > avg(price) OVER w THEN 1 ELSE 0 END END AS exposure FROM month_ends
 WINDOW w AS (PARTITION BY security_id ORDER BY month ROWS 9 PRECEDING)""",
)(lambda d: pf.sma_exposure(priced(d)))
q(
    "win_19_vol_target",
    "security_id:s, ts:t, exposure:f",
    """SELECT security_id, ts, CASE WHEN n = 21 THEN least(1, 0.1::DOUBLE / vol) END AS exposure FROM (SELECT *, count(ret) OVER w AS n, stddev_samp(ret) OVER w * sqrt(252.0::DOUBLE) AS vol FROM (
 SELECT security_id, ts, px / lag(px) OVER (PARTITION BY security_id ORDER BY ts) - 1 AS ret FROM (SELECT *, coalesce(adjusted_close, close) AS px FROM bars) WHERE px > 0)
 WINDOW w AS (PARTITION BY security_id ORDER BY ts ROWS 20 PRECEDING))""",
)(lambda d: pf.vol_target_exposure(priced(d)))


def spans(d: Domain):
    return d.bars.groupBy(F.col("security_id").alias("grp")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


VIEWS["spans"] = "SELECT security_id AS grp, min(ts) AS start, max(ts) AS \"end\" FROM bars GROUP BY 1"
q(
    "win_20_walk_forward_windows",
    "grp:s, train_start:t, train_end:t, test_end:t",
    """WITH RECURSIVE chain(grp, fin, train_start) AS (SELECT grp, "end", start FROM spans UNION ALL SELECT grp, fin, train_start + INTERVAL 6 MONTH FROM chain WHERE train_start < fin)
 SELECT grp, train_start, train_start + INTERVAL 24 MONTH AS train_end, train_start + INTERVAL 24 MONTH + INTERVAL 6 MONTH AS test_end FROM chain WHERE train_start + INTERVAL 24 MONTH + INTERVAL 6 MONTH <= fin""",
)(lambda d: pf.walk_forward(spans(d), 24, 6, 6))
q(
    "win_21_fixed_windows",
    "grp:s, train_start:t, train_end:t, test_end:t",
    """SELECT grp, s AS train_start, s + INTERVAL 500 DAY AS train_end, s + INTERVAL 600 DAY AS test_end FROM (
 SELECT grp, unnest(generate_series(start, "end" - INTERVAL 600 DAY, INTERVAL 90 DAY)) AS s FROM spans)""",
)(lambda d: pf.fixed_windows(spans(d), 500, 100, 90))
q(
    "win_22_split_at_date",
    "security_id:s, part:s, n:i",
    "SELECT security_id, CASE WHEN ts < TIMESTAMP '1999-07-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM bars GROUP BY 1, 2",
)(
    lambda d: d.bars.groupBy("security_id", F.when(F.col("ts") < F.lit("1999-07-01").cast("timestamp"), "train").otherwise("test").alias("part")).agg(
        F.count(F.lit(1)).alias("n")
    )
)
q(
    "win_23_chronological_split",
    "grp:s, train_start:t, train_end:t, validation_end:t, test_end:t",
    """SELECT grp, start AS train_start, make_timestamp(CAST(epoch_us(start) + round((epoch_us("end") - epoch_us(start)) * 0.6::DOUBLE) AS BIGINT)) AS train_end,
 make_timestamp(CAST(epoch_us(start) + round((epoch_us("end") - epoch_us(start)) * 0.8::DOUBLE) AS BIGINT)) AS validation_end, "end" AS test_end FROM spans""",
)(lambda d: pf.chronological_split(spans(d)))
q("win_24_forward_return", "security_id:s, as_of:t, fwd:f", f"SELECT * FROM {forward_sql('bar_revisions', 'grid_q', 60)}")(
    lambda d: sg.forward_return(d.bar_revisions, QUARTERS, 60)
)
q(
    "win_25_rank_average",
    "ts:t, security_id:s, r:f",
    "SELECT ts, security_id, rank() OVER (PARTITION BY ts ORDER BY close) + (count(*) OVER (PARTITION BY ts, close) - 1) / 2.0::DOUBLE AS r FROM bars",
)(lambda d: d.bars.select("ts", "security_id", average_rank("close", "ts").alias("r")))
q(
    "jon_32_benchmark_relative",
    "grp:s, beta:f, tracking_error:f, information_ratio:f, alpha:f",
    """SELECT grp, beta, te AS tracking_error, ma * 252 / te AS information_ratio, (mp - beta * mb) * 252 AS alpha FROM (
 SELECT grp, covar_samp(rp, rb) / var_samp(rb) AS beta, stddev_samp(rp - rb) * sqrt(252.0::DOUBLE) AS te, avg(rp - rb) AS ma, avg(rp) AS mp, avg(rb) AS mb FROM (
 SELECT grp, value / lag(value) OVER w - 1 AS rp, level / lag(level) OVER w - 1 AS rb FROM nav JOIN benchmark_levels USING (ts) WINDOW w AS (PARTITION BY grp ORDER BY ts)) GROUP BY 1)""",
)(lambda d: pf.relative_metrics(nav(d), d.benchmark.withColumnRenamed("level", "value")))
VIEWS["streaks"] = """SELECT security_id, coalesce(max(CASE WHEN won THEN n END), 0) AS max_wins, coalesce(max(CASE WHEN NOT won THEN n END), 0) AS max_losses FROM (
 SELECT security_id, won, k, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY fill_time, trade_id) - row_number() OVER (PARTITION BY security_id, won ORDER BY fill_time, trade_id) AS k FROM (
 SELECT *, realized_pnl > 0 AS won FROM trades)) GROUP BY 1, 2, 3) GROUP BY 1"""
q("agg_20_streaks", "security_id:s, max_wins:i, max_losses:i", "SELECT * FROM streaks")(
    lambda d: pf.streaks(d.trades, ["security_id"], ["fill_time", "trade_id"])
)
