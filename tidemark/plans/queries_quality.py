"""Quality checks and table audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as dq
from tidemark.plans.domain import Domain
from tidemark.plans.oracle import VIEWS
from tidemark.plans.registry import query

COLS = "check_name:s, severity:s, security_id:s, ts:t"


# rows with planted faults, derived from the bars: swapped high/low, sign flips, jumps, NaN, unknown names
def faulty(d: Domain, revisions: bool = True):
    b = d.bar_revisions if revisions else d.bars
    day = F.dayofyear("ts")
    return (
        b.withColumn("high", F.when(day % 50 == 1, F.col("low") - 1).otherwise(F.col("high")))
        .withColumn("low", F.when(day % 60 == 2, F.lit(-1.0)).otherwise(F.col("low")))
        .withColumn("volume", F.when(day % 70 == 3, -F.col("volume")).otherwise(F.col("volume")))
        .withColumn("close", F.when(day % 80 == 4, F.col("close") * 2).otherwise(F.col("close")))
        .withColumn("adjusted_high", F.when(day % 90 == 5, F.lit(float("nan"))).otherwise(F.col("adjusted_high")))
        .withColumn("security_id", F.when(day % 100 == 6, F.concat(F.lit("X"), F.col("security_id"))).otherwise(F.col("security_id")))
        .withColumn("ingestion_time", F.when(day % 110 == 7, F.col("ts")).otherwise(F.col("ingestion_time")))
    )


def _faulty_sql(source: str) -> str:
    return f"""SELECT * REPLACE (
 CASE WHEN dayofyear(ts) % 50 = 1 THEN low - 1 ELSE high END AS high,
 CASE WHEN dayofyear(ts) % 60 = 2 THEN -1.0::DOUBLE ELSE low END AS low,
 CASE WHEN dayofyear(ts) % 70 = 3 THEN -volume ELSE volume END AS volume,
 CASE WHEN dayofyear(ts) % 80 = 4 THEN close * 2 ELSE close END AS close,
 CASE WHEN dayofyear(ts) % 90 = 5 THEN 'nan'::DOUBLE ELSE adjusted_high END AS adjusted_high,
 CASE WHEN dayofyear(ts) % 100 = 6 THEN 'X' || security_id ELSE security_id END AS security_id,
 CASE WHEN dayofyear(ts) % 110 = 7 THEN ts ELSE ingestion_time END AS ingestion_time) FROM {source}"""


VIEWS["faulty_revisions"] = _faulty_sql("bar_revisions")
VIEWS["faulty_bars"] = _faulty_sql("bars")
NOW = "TIMESTAMP '2001-10-28'"
MIN_BARS = 1500


def now():
    return F.lit("2001-10-28").cast("timestamp")


def minimum(d: Domain):
    return d.sector.select("security_id", F.lit(MIN_BARS).alias("min_bars"))


def known(d: Domain):
    return d.sector.select("security_id")


def _row(check: str, severity: str, source: str, where: str, ts: str = "ts") -> str:
    return f"SELECT '{check}' AS check_name, {severity} AS severity, security_id, {ts} AS ts FROM {source} WHERE {where}"


SQL = {
    "01_duplicates": _row(
        "duplicate_records",
        "CASE WHEN versions > 1 THEN 'WARNING' ELSE 'ERROR' END",
        "(SELECT security_id, ts, source, count(*) AS n, count(DISTINCT data_version) AS versions FROM faulty_revisions GROUP BY 1, 2, 3)",
        "n > 1",
    ),
    "02_timestamp_monotonicity": _row(
        "timestamp_monotonicity",
        "'WARNING'",
        "(SELECT *, max(ts) OVER (PARTITION BY security_id ORDER BY seq, ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM faulty_revisions)",
        "ts < latest",
    ),
    "03_non_finite": _row("non_finite_value", "'CRITICAL'", "faulty_revisions", "isnan(adjusted_high)"),
    "04_ohlc": _row("ohlc_consistency", "'ERROR'", "faulty_revisions", "NOT (high >= greatest(open, close) AND low <= least(open, close) AND high >= low)"),
    "05_bad_price": _row("negative_or_zero_price", "'ERROR'", "faulty_revisions", "least(open, high, low, close) <= 0"),
    "06_negative_volume": _row("negative_volume", "'ERROR'", "faulty_revisions", "volume < 0"),
    "07_impossible_movement": _row(
        "impossible_price_movement",
        "'WARNING'",
        "(SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY ts) AS prev FROM faulty_bars)",
        "prev > 0 AND abs(close - prev) / prev > 0.5",
    ),
    "08_symbol_mismatch": _row("symbol_mismatch", "'ERROR'", "faulty_revisions", "security_id NOT IN (SELECT security_id FROM sector)"),
    "09_future_dated": _row("future_dated", "'ERROR'", "faulty_revisions", f"available_time > {NOW}"),
    "10_stale": _row("stale_data", "'WARNING'", "(SELECT security_id, max(ts) AS ts FROM faulty_bars GROUP BY 1)", f"{NOW} - ts > INTERVAL 5 DAY"),
    "11_ingestion_order": _row("ingestion_precedes_availability", "'ERROR'", "faulty_revisions", "ingestion_time < available_time")
    + " UNION ALL "
    + _row("ingestion_precedes_availability", "'ERROR'", "actions", "ingestion_time < available_time", "event_time"),
    "12_gaps": _row(
        "missing_timestamp_gaps",
        "'WARNING'",
        "(SELECT *, date_diff('day', lag(ts) OVER (PARTITION BY security_id ORDER BY ts), ts) AS gap FROM faulty_bars)",
        "gap > 4",
    ),
    "13_coverage": f"""SELECT 'insufficient_coverage' AS check_name, 'WARNING' AS severity, security_id, NULL::TIMESTAMP AS ts FROM sector
 LEFT JOIN (SELECT security_id, count(*) AS n FROM faulty_bars GROUP BY 1) USING (security_id) WHERE coalesce(n, 0) < {MIN_BARS}""",
    "14_split_consistency": """SELECT 'split_consistency' AS check_name, 'WARNING' AS severity, security_id, effective AS ts FROM (
 SELECT r.security_id, r.effective, r.split_ratio, (SELECT arg_max(b.close, b.ts) FROM faulty_bars b WHERE b.security_id = r.security_id AND b.ts < r.effective) AS c0,
 (SELECT arg_min(b.close, b.ts) FROM faulty_bars b WHERE b.security_id = r.security_id AND b.ts >= r.effective) AS c1 FROM split_rows r)
 WHERE c0 > 0 AND c1 > 0 AND abs(c0 / c1 - split_ratio) / split_ratio > 0.5""",
    "15_dividend_consistency": """SELECT 'dividend_consistency' AS check_name, 'ERROR' AS severity, security_id, effective AS ts FROM (
 SELECT a.security_id, coalesce(effective_time, event_time) AS effective, amount * 12 AS amount, (SELECT arg_max(b.close, b.ts) FROM faulty_bars b
  WHERE b.security_id = a.security_id AND b.ts <= coalesce(effective_time, event_time)) AS c0,
 (SELECT arg_min(b.close, b.ts) FROM faulty_bars b WHERE b.security_id = a.security_id) AS c1 FROM actions a WHERE action_type = 'CASH_DIVIDEND')
 WHERE coalesce(c0, c1) > 0 AND amount > coalesce(c0, c1)""",
}


def _dividends(d: Domain):
    return d.actions.withColumn("amount", F.col("amount") * 12)


CHECKS = {
    "01_duplicates": lambda d: dq.duplicates(faulty(d)),
    "02_timestamp_monotonicity": lambda d: dq.out_of_order(faulty(d)),
    "03_non_finite": lambda d: dq.non_finite(faulty(d)),
    "04_ohlc": lambda d: dq.ohlc(faulty(d)),
    "05_bad_price": lambda d: dq.bad_price(faulty(d)),
    "06_negative_volume": lambda d: dq.negative_volume(faulty(d)),
    "07_impossible_movement": lambda d: dq.extreme_moves(faulty(d, False)),
    "08_symbol_mismatch": lambda d: dq.unknown_symbols(faulty(d), known(d)),
    "09_future_dated": lambda d: dq.future_dated(faulty(d), now()),
    "10_stale": lambda d: dq.stale(faulty(d, False), now()),
    "11_ingestion_order": lambda d: dq.ingestion_inversions(faulty(d), d.actions),
    "12_gaps": lambda d: dq.gaps(faulty(d, False)),
    "13_coverage": lambda d: dq.thin_coverage(faulty(d, False), minimum(d)),
    "14_split_consistency": lambda d: dq.split_mismatch(faulty(d, False), d.actions),
    "15_dividend_consistency": lambda d: dq.dividend_too_large(faulty(d, False), _dividends(d)),
}
for _k, _fn in CHECKS.items():
    query(f"dq_{_k}", COLS, SQL[_k])(_fn)


def all_issues(d: Domain):
    return dq.run_checks(faulty(d), faulty(d, False), _dividends(d), known(d), now(), minimum(d))


VIEWS["all_issues"] = " UNION ALL ".join(f"SELECT check_name, severity, security_id, ts FROM ({s})" for s in SQL.values())

query("dq_17_run", "check_name:s, severity:s, n:i", "SELECT check_name, severity, count(*) AS n FROM all_issues GROUP BY 1, 2")(
    lambda d: all_issues(d).groupBy("check_name", "severity").agg(F.count(F.lit(1)).alias("n"))
)
query(
    "dq_16_status",
    "security_id:s, status:s, issues:i",
    """SELECT security_id, CASE max(CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'ERROR' THEN 2 ELSE 1 END) WHEN 3 THEN 'CRITICAL_FAILURE' WHEN 2 THEN 'FAILED'
 ELSE 'PASSED_WITH_WARNINGS' END AS status, count(*) AS issues FROM all_issues GROUP BY 1""",
)(lambda d: dq.run_status(all_issues(d), "security_id"))
query(
    "dq_18_new_flags",
    "security_id:s, ts:t, check_name:s, severity:s",
    """SELECT security_id, ts, check_name, min(severity) AS severity FROM all_issues i WHERE security_id IS NOT NULL AND ts IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM flags f WHERE f.security_id = i.security_id AND f.ts = i.ts AND f.check_name = i.check_name) GROUP BY 1, 2, 3""",
)(lambda d: dq.new_flags(all_issues(d), d.flags))
query(
    "dq_19_repair_inversions",
    "security_id:s, ts:t, ingestion_time:t, data_version:s",
    "SELECT security_id, ts, available_time AS ingestion_time, data_version || '-r1' AS data_version FROM faulty_revisions WHERE ingestion_time < available_time",
)(lambda d: dq.repair_inversions(faulty(d)))
query(
    "dq_20_repair_action_times",
    "record_id:s, available_time:t",
    "SELECT record_id, least(available_time, coalesce(effective_time, event_time) + INTERVAL 20 HOUR) AS available_time FROM actions",
)(lambda d: dq.repair_action_times(d.actions))


def fills(d: Domain):
    li = d.table("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.concat(F.lit("Brand#"), (F.col("l_partkey") % 25 + 1).cast("string")).alias("security_id"),
        F.col("l_shipdate").alias("fill_time"),
        F.col("l_returnflag").alias("data_version"),
    )
    o = d.table("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("decision_time"))
    return li.join(o, "order_id")


VIEWS["fills"] = """SELECT l_orderkey AS order_id, 'Brand#' || CAST(l_partkey % 25 + 1 AS VARCHAR) AS security_id, l_shipdate AS fill_time,
 l_returnflag AS data_version, o_orderdate AS decision_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
query(
    "dq_21_fill_audit",
    "problem:s, subject:s",
    """SELECT 'duplicate_fill' AS problem, CAST(order_id AS VARCHAR) AS subject FROM fills GROUP BY order_id HAVING count(*) > 1
 UNION ALL SELECT 'fill_not_after_decision', CAST(order_id AS VARCHAR) FROM fills WHERE fill_time <= decision_time
 UNION ALL SELECT 'mixed_data_version', security_id || '@' || strftime(fill_time, '%Y-%m-%d') FROM fills GROUP BY security_id, fill_time HAVING count(DISTINCT data_version) > 1""",
)(lambda d: dq.fill_audit(fills(d)))


def positions(d: Domain):
    """Customer balances as cash, signed order lines as holdings."""
    c = d.table("customer").select(F.col("c_custkey").alias("portfolio"), F.col("c_acctbal").alias("cash"))
    t = d.decisions.select("decision_id", "security_id", "action", F.col("decision_time").alias("ts")).join(
        d.table("orders").select(F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("portfolio")), "decision_id"
    )
    q = d.trades.select("decision_id", "quantity", "fill_price")
    sign = F.when(F.col("action") == "SELL", -1.0).otherwise(1.0)
    g = t.join(q, "decision_id").groupBy("portfolio", "security_id").agg(
        F.sum(sign * F.col("quantity")).alias("quantity"), F.max("ts").alias("ts"), F.max("fill_price").alias("average_cost")
    )
    return g.join(c, "portfolio")


VIEWS["positions"] = """SELECT o_custkey AS portfolio, d.security_id, sum(CASE WHEN action = 'SELL' THEN -quantity ELSE quantity END) AS quantity,
 max(decision_time) AS ts, max(fill_price) AS average_cost, max(c_acctbal) AS cash FROM decisions d JOIN orders ON o_orderkey = d.decision_id
 JOIN trades t ON t.decision_id = d.decision_id JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2"""
query(
    "dq_22_portfolio_audit",
    "portfolio:i, security_id:s, quantity:f, cash:f2",
    "SELECT * FROM positions WHERE cash < 0 OR quantity < 0",
)(lambda d: dq.portfolio_audit(positions(d)))
query(
    "dq_23_duplicate_intents",
    "decision_time:t, security_id:s, action:s, n:i",
    "SELECT decision_time, security_id, action, count(*) AS n FROM decisions GROUP BY 1, 2, 3 HAVING count(*) > 1",
)(lambda d: dq.duplicate_intents(d.decisions))
query(
    "dq_24_outside_universe",
    "decision_id:i, security_id:s, action:s",
    """SELECT decision_id, security_id, action FROM decisions d WHERE NOT EXISTS (SELECT 1 FROM membership m WHERE m.security_id = d.security_id
 AND d.decision_time >= valid_from AND (valid_to IS NULL OR d.decision_time < valid_to))
 AND NOT (action = 'SELL' AND security_id IN (SELECT security_id FROM positions WHERE quantity > 0))""",
)(lambda d: dq.outside_universe(d.decisions, d.membership, positions(d).filter(F.col("quantity") > 0)))


def checkpoints(d: Domain):
    """Sessions: the distinct bar days at 20:00."""
    return d.bars.select((F.col("ts") + F.expr("INTERVAL '20' HOUR")).alias("checkpoint")).distinct()


VIEWS["checkpoints"] = "SELECT DISTINCT ts + INTERVAL 20 HOUR AS checkpoint FROM bars"
VIEWS["timed_fills"] = """SELECT order_id, decision_time, CASE WHEN order_id % 3 = 0 THEN fill_time ELSE (decision_time + INTERVAL 20 HOUR) END AS fill_time FROM fills"""


def timed_fills(d: Domain):
    when = F.when(F.col("order_id") % 3 == 0, F.col("fill_time")).otherwise(F.col("decision_time") + F.expr("INTERVAL '20' HOUR"))
    return fills(d).select("order_id", "decision_time", when.alias("fill_time"))


query(
    "dq_25_execution_checkpoint",
    "order_id:i, decision_time:t, fill_time:t, expected:t",
    """SELECT order_id, decision_time, fill_time, expected FROM timed_fills ASOF LEFT JOIN (SELECT checkpoint, lead(checkpoint) OVER (ORDER BY checkpoint) AS expected FROM checkpoints) c
 ON decision_time >= checkpoint WHERE expected IS NULL OR fill_time <> expected""",
)(lambda d: dq.wrong_checkpoint(timed_fills(d), checkpoints(d)))
query(
    "dq_26_unpriced_positions",
    "portfolio:i, security_id:s, ts:t",
    "SELECT portfolio, security_id, ts FROM positions p WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.security_id = p.security_id AND b.ts = p.ts)",
)(lambda d: dq.unpriced_positions(positions(d), d.bars))
query(
    "dq_27_delisted_at_cost",
    "portfolio:i, security_id:s, ts:t",
    """SELECT portfolio, security_id, ts FROM positions p WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.security_id = p.security_id AND b.ts = p.ts)
 AND EXISTS (SELECT 1 FROM security_master m WHERE m.security_id = p.security_id AND status = 'DELISTED' AND p.ts >= m.valid_from)""",
)(lambda d: dq.delisted_at_cost(positions(d), d.bars, d.security_master))
query(
    "dq_28_action_timing",
    "record_id:s, applied_time:t, available_time:t",
    "SELECT record_id, coalesce(effective_time, event_time) AS applied_time, available_time FROM actions WHERE coalesce(effective_time, event_time) < available_time",
)(lambda d: dq.early_actions(d.actions.withColumn("applied_time", F.coalesce("effective_time", "event_time"))))
query(
    "dq_29_checkpoint_order",
    "seq:i, checkpoint:t",
    """SELECT seq, checkpoint FROM (SELECT *, lag(checkpoint) OVER (ORDER BY seq) AS b FROM (SELECT year(ts) * 400 + dayofyear(ts) AS seq,
 max(CASE WHEN dayofyear(ts) % 40 = 0 THEN ts - INTERVAL 3 DAY ELSE ts END) AS checkpoint FROM bars GROUP BY 1)) WHERE checkpoint <= b""",
)(
    lambda d: dq.checkpoint_disorder(
        d.bars.groupBy((F.year("ts") * 400 + F.dayofyear("ts")).alias("seq")).agg(
            F.max(F.when(F.dayofyear("ts") % 40 == 0, F.col("ts") - F.expr("INTERVAL '3' DAY")).otherwise(F.col("ts"))).alias("checkpoint")
        ),
        "seq",
    )
)
query(
    "dq_30_finalize",
    "problem:s, status:s, issues:i",
    """SELECT check_name AS problem, CASE max(CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'ERROR' THEN 2 ELSE 1 END) WHEN 3 THEN 'CRITICAL_FAILURE' WHEN 2 THEN 'FAILED'
 ELSE 'PASSED_WITH_WARNINGS' END AS status, count(*) AS issues FROM all_issues GROUP BY 1""",
)(lambda d: dq.run_status(all_issues(d).withColumnRenamed("check_name", "problem"), "problem"))
