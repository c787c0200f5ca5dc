"""Point-in-time reads: as-of, interval, range and reconciliation joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import fundamental_factors as ff
from tidemark.operators import holdings as hd
from tidemark.operators import reads as rd
from tidemark.operators.asof import asof_join, bars_on_grid, facts_on_grid, history_on_grid, newest_revision
from tidemark.plans.domain import QUARTERS, Domain
from tidemark.plans.oracle import VIEWS, panel_sql
from tidemark.plans.queries_fundamental import tracked_filers
from tidemark.plans.queries_quality import positions
from tidemark.plans.registry import query

Q = QUARTERS


def q(name, cols, sql=None):
    return query(f"jon_{name}", cols, sql)


q(
    "01_get_bars",
    "security_id:s, as_of:t, ts:t, close:f, data_version:s",
    f"""SELECT * FROM {panel_sql('bar_revisions', 'grid_q', 60, None,
 "AND NOT EXISTS (SELECT 1 FROM flags f WHERE f.severity = 'CRITICAL' AND f.security_id = b.security_id AND f.ts = b.ts)")}""",
)(lambda d: bars_on_grid(d.bar_revisions, Q, 60, d.flags))
q("02_newest_revision", "security_id:s, ts:t, close:f, data_version:s", "SELECT * FROM bars")(
    lambda d: newest_revision(d.bar_revisions, "security_id", "ts")
)
q("03_critical_times", "security_id:s, ts:t", "SELECT DISTINCT security_id, ts FROM flags WHERE severity = 'CRITICAL'")(
    lambda d: rd.critical_times(d.flags)
)
_HOLDS = "JOIN grid_q ON as_of >= valid_from AND (valid_to IS NULL OR as_of < valid_to)"
q(
    "04_get_security",
    "security_id:s, as_of:t, ticker:s, status:s, valid_from:t",
    f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id, as_of ORDER BY valid_from DESC) AS k FROM security_master {_HOLDS}) WHERE k = 1",
)(lambda d: rd.security_on_grid(d.security_master, Q))
q("05_get_universe", "universe:s, as_of:t, security_id:s", f"SELECT DISTINCT universe, as_of, security_id FROM membership {_HOLDS}")(
    lambda d: rd.universe_on_grid(d.membership, Q)
)
q(
    "06_get_corporate_actions",
    "record_id:s, as_of:t, action_type:s",
    """SELECT record_id, as_of, action_type FROM actions JOIN grid_q ON available_time <= as_of
 AND coalesce(effective_time, event_time) BETWEEN as_of - INTERVAL 365 DAY AND as_of""",
)(lambda d: rd.actions_on_grid(d.actions, Q, 365))
q(
    "07_get_benchmark",
    "as_of:t, ts:t, level:f",
    "SELECT as_of, ts, close AS level FROM benchmark_bars JOIN grid_q ON available_time <= as_of AND ts BETWEEN as_of - INTERVAL 90 DAY AND as_of",
)(lambda d: rd.benchmark_on_grid(d.benchmark_bars.withColumnRenamed("close", "level"), Q, 90))
q(
    "08_member_bars",
    "security_id:s, ts:t, close:f",
    """SELECT security_id, ts, close FROM bars b WHERE EXISTS (SELECT 1 FROM membership m WHERE m.security_id = b.security_id AND ts >= valid_from AND (valid_to IS NULL OR ts < valid_to))
 UNION ALL SELECT security_id, ts, close FROM benchmark_bars""",
)(
    lambda d: rd.member_bars(
        d.bars.select("security_id", "ts", "close").unionByName(d.benchmark_bars.select("security_id", "ts", "close")), d.membership, "BENCH"
    )
)
q(
    "09_get_fundamentals",
    "record_id:s, as_of:t, concept:s, period_end:t, value:f6",
    "SELECT record_id, as_of, concept, period_end, value FROM fundamentals JOIN grid_q ON available_time <= as_of AND period_end BETWEEN as_of - INTERVAL 400 DAY AND as_of",
)(
    lambda d: history_on_grid(d.fundamentals, Q, until=F.col("period_end") + F.expr("INTERVAL '400' DAY")).filter(
        F.col("period_end").between(F.col("as_of") - F.expr("INTERVAL '400' DAY"), F.col("as_of"))
    )
)
q(
    "10_latest_known_value",
    "security_id:s, concept:s, as_of:t, period_end:t, record_id:s, value:f6",
    """SELECT * FROM (SELECT f.*, as_of, row_number() OVER (PARTITION BY security_id, concept, as_of ORDER BY period_end DESC, available_time DESC, record_id DESC) AS k
 FROM fundamentals f JOIN grid_q ON available_time <= as_of) WHERE k = 1""",
)(lambda d: facts_on_grid(d.fundamentals, Q, ["security_id", "concept"], ["period_end", "available_time", "record_id"]))


def _igrid():
    from tidemark.plans.queries_fundamental import insider_grid

    return insider_grid()


q(
    "11_insider_window",
    "record_id:i, as_of:t, security_id:s, shares:f2",
    "SELECT record_id, as_of, security_id, shares FROM insider JOIN grid_i ON available_time <= as_of AND transaction_date BETWEEN as_of - INTERVAL 10 DAY AND as_of",
)(
    lambda d: history_on_grid(d.insider, _igrid(), until=F.col("transaction_date") + F.expr("INTERVAL '10' DAY")).filter(
        F.col("transaction_date").between(F.col("as_of") - F.expr("INTERVAL '10' DAY"), F.col("as_of"))
    )
)


def _latest_sql(table: str, keys: str, order: str) -> str:
    return f"""SELECT * FROM (SELECT t.*, as_of, row_number() OVER (PARTITION BY {keys}, as_of ORDER BY {order} DESC) AS k
 FROM {table} t JOIN grid_q ON available_time <= as_of) WHERE k = 1"""


q("12_latest_per_filer", "security_id:s, filer_cik:s, as_of:t, quarter_end:t, shares:f", _latest_sql("filer_holdings", "security_id, filer_cik", "quarter_end"))(
    lambda d: facts_on_grid(d.filer_holdings, Q, ["security_id", "filer_cik"], ["quarter_end", "available_time"])
)
q(
    "13_latest_one_filer",
    "security_id:s, as_of:t, quarter_end:t, shares:f",
    _latest_sql("(SELECT * FROM filer_holdings WHERE filer_cik = '3')", "security_id", "quarter_end"),
)(lambda d: facts_on_grid(d.filer_holdings.filter(F.col("filer_cik") == "3"), Q, ["security_id"], ["quarter_end", "available_time"]))
q("14_latest_holding", "security_id:s, as_of:t, quarter_end:t, shares:f, num_institutions:i", _latest_sql("holdings", "security_id", "quarter_end"))(
    lambda d: facts_on_grid(d.holdings, Q, ["security_id"], ["quarter_end", "available_time"])
)
q("15_holding_history", "security_id:s, as_of:t, quarter_end:t, shares:f", "SELECT * FROM holdings JOIN grid_q ON available_time <= as_of")(
    lambda d: history_on_grid(d.holdings, Q)
)
q("16_latest_short_interest", "security_id:s, as_of:t, settlement_date:t, quantity:f", _latest_sql("short_interest", "security_id", "settlement_date"))(
    lambda d: facts_on_grid(d.short_interest, Q, ["security_id"], ["settlement_date", "available_time"])
)
q("17_short_interest_history", "security_id:s, as_of:t, settlement_date:t, quantity:f", "SELECT * FROM short_interest JOIN grid_q ON available_time <= as_of")(
    lambda d: history_on_grid(d.short_interest, Q)
)
VIEWS["macro_known"] = """SELECT series_id, observation_date, as_of, value FROM (SELECT m.*, as_of, row_number() OVER (PARTITION BY series_id, observation_date, as_of ORDER BY realtime_start DESC) AS k
 FROM macro_vintages m JOIN grid_q ON available_time <= as_of) WHERE k = 1 AND value IS NOT NULL AND (realtime_end IS NULL OR realtime_end + INTERVAL 2 DAY + INTERVAL 6 HOUR > as_of)"""
VIEWS["macro_latest"] = "SELECT series_id, as_of, max(observation_date) AS observation_date, arg_max(value, observation_date) AS value FROM macro_known GROUP BY 1, 2"
q("18_series_as_of", "series_id:s, observation_date:t, as_of:t, value:f2", "SELECT * FROM macro_known")(lambda d: rd.series_on_grid(d.macro_vintages, Q))
q("19_latest_as_of", "series_id:s, as_of:t, observation_date:t, value:f2", "SELECT * FROM macro_latest")(
    lambda d: rd.latest_on_grid(rd.series_on_grid(d.macro_vintages, Q))
)
q(
    "20_fallback_lag",
    "series_id:s, observation_date:t, realtime_start:t, available_time:t",
    """SELECT series_id, observation_date, realtime_start, CASE WHEN realtime_start = f AND observation_date < f THEN least(available_time, observation_date + INTERVAL 31 DAY + INTERVAL 6 HOUR)
 ELSE available_time END AS available_time FROM macro_vintages JOIN (SELECT series_id, min(realtime_start) AS f FROM macro_vintages GROUP BY 1) USING (series_id)""",
)(lambda d: rd.with_fallback_lag(d.macro_vintages, 30))

# ---- per-row as-of joins: regimes, predictions, decisions, sizing and risk rows at decision time -----


def regimes(d: Domain):
    """Monthly composite per security: direction of the month and its width."""
    m = d.bars.groupBy("security_id", F.date_trunc("month", "ts").alias("month")).agg(
        F.min_by("close", "ts").alias("a"), F.max_by("close", "ts").alias("b"), (F.max("close") - F.min("close")).alias("w")
    )
    return m.select(
        "security_id",
        (F.col("month") + F.expr("INTERVAL '32' DAY")).alias("regime_time"),
        F.when(F.col("b") > F.col("a"), "UP").otherwise("DOWN").alias("trend"),
        F.when(F.col("w") > 18, "HIGH").otherwise("NORMAL").alias("volatility"),
        F.when(F.month("month") % 4 != 0, F.concat_ws("_", F.lit("R"), F.month("month").cast("string"))).alias("label"),
    )


VIEWS["regimes"] = """SELECT security_id, m + INTERVAL 32 DAY AS regime_time, CASE WHEN b > a THEN 'UP' ELSE 'DOWN' END AS trend,
 CASE WHEN w > 18 THEN 'HIGH' ELSE 'NORMAL' END AS volatility, CASE WHEN month(m) % 4 <> 0 THEN 'R_' || CAST(month(m) AS VARCHAR) END AS label FROM (
 SELECT security_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, arg_min(close, ts) AS a, arg_max(close, ts) AS b, max(close) - min(close) AS w FROM bars GROUP BY 1, 2)"""


def predictions(d: Domain):
    """Several forecasts per security and week; ties in time are broken by id."""
    b = d.bars
    return b.select(
        "security_id",
        F.date_trunc("week", "ts").alias("prediction_time"),
        F.dayofyear("ts").alias("prediction_id"),
        F.round(F.col("close") / 100 - 1, 6).alias("expected_return"),
        F.round(F.col("volume") / 50, 6).alias("confidence"),
        F.when(F.col("volume") > 3, "COMPLETED").otherwise("INSUFFICIENT_DATA").alias("status"),
    )


VIEWS["predictions"] = """SELECT security_id, CAST(date_trunc('week', ts) AS TIMESTAMP) AS prediction_time, dayofyear(ts) AS prediction_id, round(close / 100 - 1, 6) AS expected_return,
 round(volume / 50, 6) AS confidence, CASE WHEN volume > 3 THEN 'COMPLETED' ELSE 'INSUFFICIENT_DATA' END AS status FROM bars"""
VIEWS["decisions_ranked"] = "SELECT *, row_number() OVER (PARTITION BY security_id, decision_time ORDER BY decision_id DESC) AS dk FROM decisions"
VIEWS["pred_last"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id, prediction_time ORDER BY prediction_id DESC) AS pk FROM predictions) WHERE pk = 1"
q(
    "21_regime_as_of",
    "decision_id:i, regime_time:t, trend:s, volatility:s",
    "SELECT decision_id, regime_time, trend, volatility FROM decisions d ASOF LEFT JOIN regimes r ON d.security_id = r.security_id AND d.decision_time >= r.regime_time",
)(lambda d: asof_join(d.decisions, regimes(d), ["security_id"], "decision_time", "regime_time"))
q(
    "22_prediction_as_of",
    "decision_id:i, prediction_time:t, prediction_id:i, expected_return:f",
    "SELECT decision_id, prediction_time, prediction_id, expected_return FROM decisions d ASOF LEFT JOIN pred_last p ON d.security_id = p.security_id AND d.decision_time >= p.prediction_time",
)(lambda d: asof_join(d.decisions.drop("confidence"), predictions(d), ["security_id"], "decision_time", "prediction_time", tie=["prediction_id"]))


def rates(d: Domain):
    """A daily yield series from the events-free order prices."""
    return d.table("orders").groupBy(F.col("o_orderdate").alias("ts")).agg(F.round(F.sum("o_totalprice") / 100000, 7).alias("rate")).filter(
        F.dayofyear("ts") % 17 > 12
    )


VIEWS["rates"] = "SELECT o_orderdate AS ts, round(sum(o_totalprice) / 100000, 7) AS rate FROM orders WHERE dayofyear(o_orderdate) % 17 > 12 GROUP BY 1"
q(
    "23_rate_before",
    "ts:t, annual_rate:f",
    """SELECT b.ts, CASE WHEN date_diff('day', r.ts, b.ts) <= 10 THEN rate / 100 END AS annual_rate FROM benchmark_levels b ASOF LEFT JOIN rates r ON b.ts > r.ts""",
)(lambda d: rd.rate_before(d.benchmark.select("ts"), rates(d), "ts"))


LIQUID = 60.0  #: volume of a week that puts a brand into the index


def snapshots(d: Domain):
    """Index snapshots: the brands of each week with enough volume in it."""
    weeks = d.bars.groupBy(F.date_trunc("week", "ts").alias("snapshot"), F.col("security_id").alias("ticker")).agg(F.sum("volume").alias("volume"))
    return weeks.filter(F.col("volume") >= LIQUID).select("snapshot", "ticker")


VIEWS["snapshots"] = f"SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS snapshot, security_id AS ticker FROM bars GROUP BY 1, 2 HAVING sum(volume) >= {LIQUID}"
q(
    "24_membership_snapshot",
    "ts:t, snapshot:t, stale_days:i",
    "SELECT ts, snapshot, date_diff('day', snapshot, ts) AS stale_days FROM benchmark_levels b ASOF LEFT JOIN (SELECT DISTINCT snapshot FROM snapshots) s ON ts >= snapshot",
)(lambda d: rd.snapshot_before(d.benchmark.select("ts"), snapshots(d), "ts"))


BUSY = 40.0  #: volume of a busy day


def intervals(d: Domain):
    """Closed index intervals per ticker: one span per brand and half-decade, from its first to its last busy day."""
    era = F.when(F.year("ts") < 1998, 1).otherwise(2)
    g = d.bars.filter(F.col("volume") >= BUSY).groupBy(F.col("security_id").alias("ticker"), era.alias("era")).agg(
        F.min("ts").alias("start_date"), F.max("ts").alias("last")
    )
    n = F.regexp_extract("ticker", r"(\d+)$", 1).cast("int")
    return g.select("ticker", "start_date", F.when((F.col("era") == 1) | (n % 3 == 0), F.col("last")).alias("end_date"))


VIEWS["intervals"] = f"""SELECT ticker, a AS start_date, CASE WHEN era = 1 OR CAST(regexp_extract(ticker, '([0-9]+)$', 1) AS INT) % 3 = 0 THEN b END AS end_date FROM (
 SELECT security_id AS ticker, CASE WHEN year(ts) < 1998 THEN 1 ELSE 2 END AS era, min(ts) AS a, max(ts) AS b FROM bars
 WHERE volume >= {BUSY} GROUP BY 1, 2)"""
VIEWS["renames"] = "SELECT DISTINCT p_brand AS old_ticker, 'N' || p_brand AS new_ticker FROM part WHERE CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) % 4 = 0"


def renames(d: Domain):
    n = F.regexp_extract("security_id", r"(\d+)$", 1).cast("int")
    return d.sector.filter(n % 4 == 0).select(F.col("security_id").alias("old_ticker"), F.concat(F.lit("N"), "security_id").alias("new_ticker"))


SINCE = "TIMESTAMP '2001-01-01'"


def since():
    return F.lit("2001-01-01").cast("timestamp")


q(
    "25_constituents_as_of",
    "ticker:s, as_of:t",
    "SELECT ticker, as_of FROM intervals JOIN grid_q ON as_of >= start_date AND (end_date IS NULL OR as_of <= end_date)",
)(lambda d: rd.spans_on_grid(intervals(d), Q, "start_date", "end_date", closed=True))
q("26_removed_since", "ticker:s, end_date:t", f"SELECT ticker, end_date FROM intervals WHERE end_date >= {SINCE}")(
    lambda d: rd.removed_since(intervals(d), since())
)
q(
    "27_ticker_renames",
    "ticker:s, start_date:t",
    "SELECT coalesce(new_ticker, ticker) AS ticker, start_date FROM intervals LEFT JOIN renames ON old_ticker = ticker",
)(lambda d: rd.renamed(intervals(d), renames(d)))
# members under the name of today: the bars of a renamed one stand under its former name
_PRICED = "(SELECT DISTINCT security_id FROM bars)"
VIEWS["members_today"] = "SELECT coalesce(new_ticker, ticker) AS ticker, start_date, end_date FROM intervals LEFT JOIN renames ON old_ticker = ticker"


def members_today(d: Domain):
    return rd.renamed(intervals(d), renames(d))


q(
    "28_members_with_prices",
    "year:i, members:i, with_prices:i, coverage:f",
    f"""SELECT year, count(*) AS members, count(security_id) AS with_prices, count(security_id) / count(*) AS coverage FROM (
 SELECT DISTINCT y AS year, ticker FROM members_today, LATERAL (SELECT unnest(generate_series(year(start_date), year(coalesce(end_date, (SELECT max(ts) FROM bars))))) AS y)
 WHERE start_date <= make_timestamp(y, 1, 1, 0, 0, 0.0) AND (end_date IS NULL OR make_timestamp(y, 1, 1, 0, 0, 0.0) <= end_date))
 LEFT JOIN {_PRICED} ON security_id = ticker GROUP BY 1""",
)(lambda d: rd.members_with_prices(members_today(d), d.bars))
q(
    "29_removed_coverage",
    "removed:i, covered:i, percentage:f",
    f"""SELECT count(*) AS removed, count(security_id) AS covered, 100.0::DOUBLE * count(security_id) / count(*) AS percentage FROM (
 SELECT DISTINCT ticker FROM members_today WHERE end_date >= {SINCE}) LEFT JOIN {_PRICED} ON security_id = ticker""",
)(lambda d: rd.removed_coverage(members_today(d), d.bars, since()))
VIEWS["listings"] = "SELECT security_id AS ticker, valid_from AS listed_from, valid_to AS listed_to FROM security_master WHERE status = 'DELISTED'"


def listings(d: Domain):
    m = d.security_master.filter(F.col("status") == "DELISTED")
    return m.select(F.col("security_id").alias("ticker"), F.col("valid_from").alias("listed_from"), F.col("valid_to").alias("listed_to"))


q(
    "30_listing_overlap",
    "ticker:s, listed:b",
    """SELECT ticker, bool_or(EXISTS (SELECT 1 FROM listings l WHERE l.ticker = i.ticker AND (listed_to IS NULL OR start_date <= listed_to) AND (end_date IS NULL OR listed_from <= end_date))) AS listed
 FROM intervals i GROUP BY 1""",
)(lambda d: rd.listing_overlap(intervals(d), listings(d)))
q(
    "31_ticker_collisions",
    "ticker:s, first_id:s, second_id:s",
    """SELECT a.ticker, a.security_id AS first_id, b.security_id AS second_id FROM security_master a JOIN security_master b ON a.ticker = b.ticker AND a.security_id < b.security_id
 AND (b.valid_to IS NULL OR a.valid_from < b.valid_to) AND (a.valid_to IS NULL OR b.valid_from < a.valid_to)""",
)(lambda d: rd.ticker_collisions(d.security_master))
q(
    "33_regime_context",
    "decision_id:i, regime:s",
    """SELECT decision_id, coalesce(label, nullif(concat_ws('|', trend, volatility), '')) AS regime FROM decisions d ASOF LEFT JOIN regimes r
 ON d.security_id = r.security_id AND d.decision_time >= r.regime_time""",
)(lambda d: rd.with_regime(d.decisions, regimes(d)))


def records(d: Domain):
    return d.decisions.select("decision_id", "security_id", "decision_time", F.when(F.col("confidence") > 0.5, F.col("confidence")).alias("expected_outcome"))


q(
    "34_prediction_context",
    "decision_id:i, expected_outcome:f",
    """SELECT decision_id, coalesce(CASE WHEN d.confidence > 0.5 THEN d.confidence END, expected_return) AS expected_outcome FROM decisions d
 ASOF LEFT JOIN pred_last p ON d.security_id = p.security_id AND d.decision_time >= p.prediction_time""",
)(lambda d: rd.with_prediction(records(d), predictions(d)))


def analyses(d: Domain):
    """Versions of post-trade analysis: one per order line."""
    li = d.table("lineitem")
    return li.select(
        F.col("l_orderkey").alias("trade_id"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"),
        F.col("l_tax").alias("error"),
    ).groupBy("trade_id", "seq").agg(F.max("error").alias("error"))


def counterfactuals(d: Domain):
    li = d.table("lineitem").filter(F.col("l_returnflag") == "R")
    return li.groupBy(F.col("l_orderkey").alias("trade_id"), F.col("l_suppkey").alias("seq")).agg(F.max("l_discount").alias("alternative"))


VIEWS["analyses"] = "SELECT l_orderkey AS trade_id, l_linenumber * 1000000 + l_partkey AS seq, max(l_tax) AS error FROM lineitem GROUP BY 1, 2"
VIEWS["counterfactuals"] = "SELECT l_orderkey AS trade_id, l_suppkey AS seq, max(l_discount) AS alternative FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2"
VIEWS["experience"] = """SELECT t.trade_id, t.decision_id, t.security_id, t.fill_time, t.realized_return, t.realized_pnl, t.quantity, t.fill_price, d.decision_time, d.action, d.provenance, d.confidence,
 a.seq AS analysis_seq, a.error, c.seq AS counter_seq, c.alternative FROM trades t LEFT JOIN decisions d ON d.decision_id = t.decision_id
 LEFT JOIN (SELECT trade_id, max(seq) AS seq, arg_max(error, seq) AS error FROM analyses GROUP BY 1) a ON a.trade_id = t.trade_id
 LEFT JOIN (SELECT trade_id, max(seq) AS seq, arg_max(alternative, seq) AS alternative FROM counterfactuals GROUP BY 1) c ON c.trade_id = t.trade_id"""


def experience(d: Domain):
    return rd.experience_records(d.trades, d.decisions, analyses(d), counterfactuals(d))


q("35_experience_records", "trade_id:i, action:s, analysis_seq:i, error:f, counter_seq:i, alternative:f", "SELECT * FROM experience")(experience)
q("36_audit_trail", "trade_id:i, action:s, versions:i", "SELECT t.trade_id, action, versions FROM trades t LEFT JOIN decisions d USING (decision_id) LEFT JOIN (SELECT trade_id, count(*) AS versions FROM analyses GROUP BY 1) a ON a.trade_id = t.trade_id")(
    lambda d: rd.audit_trail(d.trades, d.decisions, analyses(d))
)
q("37_latest_analysis", "trade_id:i, seq:i, error:f", "SELECT trade_id, max(seq) AS seq, arg_max(error, seq) AS error FROM analyses GROUP BY 1")(
    lambda d: rd.latest_by(analyses(d), ["trade_id"], "seq")
)
q(
    "38_record_decision_once",
    "security_id:s, decision_time:t, decision_id:i",
    """SELECT security_id, decision_time, min(decision_id) AS decision_id FROM decisions d WHERE provenance <> 'REAL' AND NOT EXISTS (
 SELECT 1 FROM decisions s WHERE s.provenance = 'REAL' AND s.security_id = d.security_id AND s.decision_time = d.decision_time) GROUP BY 1, 2""",
)(
    lambda d: rd.append_once(
        d.decisions.filter(F.col("provenance") != "REAL"),
        d.decisions.filter(F.col("provenance") == "REAL"),
        ["security_id", "decision_time"],
        ["decision_id"],
    )
)


def health(d: Domain):
    e = d.table("events")
    return e.select(
        F.col("event_type").alias("component"),
        F.date_trunc("day", "ts").alias("as_of_time"),
        F.col("event_id").alias("seq"),
        F.when(F.col("value") > 80, "UNAVAILABLE").when(F.col("value") > 40, "DEGRADED").otherwise("HEALTHY").alias("status"),
        "value",
        F.col("user_id").alias("subject_id"),
    )


VIEWS["health"] = """SELECT event_type AS component, CAST(date_trunc('day', ts) AS TIMESTAMP) AS as_of_time, event_id AS seq,
 CASE WHEN value > 80 THEN 'UNAVAILABLE' WHEN value > 40 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status, value, user_id AS subject_id FROM events"""
q("39_latest_health", "component:s, seq:i, status:s", "SELECT component, arg_max(seq, seq) AS seq, arg_max(status, seq) AS status FROM health h WHERE as_of_time = (SELECT max(as_of_time) FROM health k WHERE k.component = h.component) GROUP BY 1")(
    lambda d: rd.latest_by(health(d), ["component"], "as_of_time", "seq")
)
VIEWS["adjusted_holdings"] = """SELECT h.security_id, as_of, quarter_end, shares * coalesce(exp(sum(ln(split_ratio))), 1) AS shares FROM (
 SELECT h.*, as_of FROM holdings h JOIN grid_q ON available_time <= as_of) h LEFT JOIN (SELECT * FROM (SELECT *, CASE WHEN split_ratio >= 1 THEN split_ratio ELSE 1 / split_ratio END AS up FROM split_rows) WHERE
 list_has_any([true], [round_even(up * k, 0) > k AND abs(up - round_even(up * k, 0) / k) <= 0.001 * up FOR k IN [1, 2, 3, 4]])) r
 ON r.security_id = h.security_id AND effective > quarter_end AND effective <= as_of AND known <= as_of GROUP BY h.security_id, as_of, quarter_end, shares"""
q("40_split_adjusted_history", "security_id:s, as_of:t, quarter_end:t, big:f3", "SELECT *, ln(shares) AS big FROM adjusted_holdings")(
    lambda d: hd.split_adjusted_holdings(d.holdings, d.actions, Q).withColumn("big", F.ln("shares"))
)
q(
    "41_split_factor",
    "security_id:s, as_of:t, factor:f3",
    """SELECT security_id, as_of, sum(ln(split_ratio)) AS factor FROM grid_q JOIN split_rows ON effective > as_of - INTERVAL 365 DAY AND effective <= as_of GROUP BY 1, 2""",
)(
    lambda d: hd.split_product(
        rd.spans_on_grid(d.sector.withColumn("valid_from", F.lit("1990-01-01").cast("timestamp")).withColumn("valid_to", F.lit(None).cast("timestamp")), Q)
        .withColumn("back", F.col("as_of") - F.expr("INTERVAL '365' DAY")),
        d.actions,
        "back",
        "as_of",
        ["security_id", "as_of"],
    ).select("security_id", "as_of", F.ln("split_factor").alias("factor"))
)


def external(d: Domain):
    """The other side's book: some names missing, some quantities off."""
    p = positions(d)
    return p.filter(F.col("portfolio") % 7 != 0).withColumn("quantity", F.when(F.col("portfolio") % 5 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")))


VIEWS["external_book"] = "SELECT portfolio, security_id, CASE WHEN portfolio % 5 = 0 THEN quantity + 1 ELSE quantity END AS quantity, cash FROM positions WHERE portfolio % 7 <> 0"
q(
    "42_compare_positions",
    "portfolio:i, security_id:s, own:f, other:f, status:s",
    """SELECT portfolio, security_id, p.quantity AS own, e.quantity AS other, CASE WHEN p.quantity IS NULL OR e.quantity IS NULL THEN 'UNKNOWN'
 WHEN abs(p.quantity - e.quantity) <= 1e-6 THEN 'MATCHED' ELSE 'MISMATCH' END AS status FROM positions p FULL JOIN external_book e USING (portfolio, security_id)""",
)(lambda d: rd.compare_positions(positions(d), external(d)))
q(
    "43_compare_cash",
    "portfolio:i, own:f2, other:f2, status:s",
    """SELECT c_custkey AS portfolio, c_acctbal AS own, e.cash AS other, CASE WHEN e.cash IS NULL THEN 'UNKNOWN' WHEN abs(c_acctbal - e.cash) <= 5 THEN 'MATCHED' ELSE 'MISMATCH' END AS status
 FROM customer LEFT JOIN (SELECT c_custkey AS k, c_acctbal + c_custkey % 10 AS cash FROM customer WHERE c_custkey % 7 <> 0) e ON k = c_custkey""",
)(
    lambda d: rd.compare_values(
        d.table("customer").select(F.col("c_custkey").alias("portfolio"), F.col("c_acctbal").alias("cash")),
        d.table("customer").filter(F.col("c_custkey") % 7 != 0).select(F.col("c_custkey").alias("portfolio"), (F.col("c_acctbal") + F.col("c_custkey") % 10).alias("cash")),
        "portfolio",
        "cash",
        5.0,
    )
)
q(
    "44_compare_status",
    "order_id:i, own:s, other:s, status:s",
    """SELECT o_orderkey AS order_id, o_orderstatus AS own, x AS other, CASE WHEN x IS NULL THEN 'UNKNOWN' WHEN x = o_orderstatus THEN 'MATCHED' ELSE 'MISMATCH' END AS status
 FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS x FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)(
    lambda d: rd.compare_values(
        d.table("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("state")),
        d.table("lineitem")
        .join(d.table("orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
        .groupBy(F.col("l_orderkey").alias("order_id"))
        .agg(F.max("l_linestatus").alias("state")),
        "order_id",
        "state",
    )
)
VIEWS["part_cusips"] = "SELECT p_brand AS ticker, lpad(CAST(p_partkey % 1500 AS VARCHAR), 9, '0') AS cusip FROM part"
VIEWS["resolved_cusips"] = "SELECT DISTINCT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS cusip, p_brand AS ticker FROM part WHERE p_size <= 17"


def part_cusips(d: Domain):
    return d.table("part").select(F.col("p_brand").alias("ticker"), F.lpad((F.col("p_partkey") % 1500).cast("string"), 9, "0").alias("cusip"))


q(
    "45_confirm_cusips",
    "ticker:s, cusip:s",
    """SELECT min(p.ticker) AS ticker, cusip FROM part_cusips p LEFT JOIN resolved_cusips r USING (cusip) WHERE r.ticker IS NULL OR r.ticker = p.ticker GROUP BY cusip HAVING count(*) = 1""",
)(
    lambda d: rd.confirm_cusips(
        part_cusips(d),
        d.table("part").filter(F.col("p_size") <= 17).select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("cusip"), F.col("p_brand").alias("ticker")),
    )
)
VIEWS["reports"] = "SELECT DISTINCT security_id AS symbol, CAST(date_trunc('year', ts) AS TIMESTAMP) AS window_start, CAST(date_trunc('year', ts) + INTERVAL 1 YEAR AS TIMESTAMP) AS window_end FROM bars"


def reports(d: Domain):
    y = F.date_trunc("year", "ts")
    return d.bars.select(
        F.col("security_id").alias("symbol"), y.alias("window_start"), F.add_months(y, 12).cast("timestamp").alias("window_end")
    ).distinct()


q(
    "46_seen_symbols",
    "symbol:s",
    f"""SELECT symbol FROM reports WHERE window_start < TIMESTAMP '1999-01-01' AND {SINCE} - INTERVAL 3 YEAR < window_end
 UNION SELECT new_ticker FROM renames JOIN reports ON symbol = old_ticker WHERE window_start < TIMESTAMP '1999-01-01' AND {SINCE} - INTERVAL 3 YEAR < window_end""",
)(lambda d: rd.seen_symbols(reports(d), F.lit("1998-01-01").cast("timestamp"), F.lit("1999-01-01").cast("timestamp"), renames(d)))
q(
    "47_value_on_or_before",
    "series_id:s, observation_date:t, value:f2",
    "SELECT series_id, max(observation_date) AS observation_date, arg_max(value, observation_date) AS value FROM macro_vintages WHERE realtime_end IS NULL AND observation_date <= TIMESTAMP '1998-05-20' GROUP BY 1",
)(lambda d: rd.value_on_or_before(d.macro_vintages.filter(F.col("realtime_end").isNull()), "series_id", "observation_date", F.lit("1998-05-20").cast("timestamp")))
q("48_history_for_ticker", "ticker:s, start_date:t, end_date:t", "SELECT * FROM intervals WHERE ticker = 'Brand#7'")(
    lambda d: intervals(d).filter(F.col("ticker") == "Brand#7").orderBy("start_date")
)


def _as_of_rows(d: Domain, probe_days: int):
    """Ledger rows as of each trade's fill time."""
    t = d.trades.select("trade_id", "security_id", (F.col("fill_time") - F.make_dt_interval(F.lit(probe_days))).alias("at"))
    rows = d.decisions.select("security_id", "decision_time", F.col("decision_id").alias("row_id"), "confidence")
    return asof_join(t, rows, ["security_id"], "at", "decision_time", tie=["row_id"])


for _no, _nm, _days in (("49", "decision", 0), ("50", "sizing", 30), ("51", "risk", 60)):
    q(
        f"{_no}_{_nm}_as_of",
        "trade_id:i, row_id:i, confidence:f",
        f"""SELECT trade_id, decision_id AS row_id, confidence FROM (SELECT trade_id, security_id, fill_time - INTERVAL {_days} DAY AS asked FROM trades) t
 ASOF LEFT JOIN (SELECT decision_id, security_id, decision_time, confidence FROM decisions_ranked WHERE dk = 1) d ON t.security_id = d.security_id AND asked >= decision_time""",
    )(lambda d, n=_days: _as_of_rows(d, n))
for _no, _nm, _keys in (
    ("52", "reconciliation_latest", ["component", "subject_id"]),
    ("53", "order_status_latest", ["subject_id"]),
    ("54", "session_report_latest", ["as_of_time"]),
):
    q(
        f"{_no}_{_nm}",
        ", ".join(f"{k}:{'s' if k == 'component' else 'i' if k == 'subject_id' else 't'}" for k in _keys) + ", seq:i, status:s",
        f"SELECT {', '.join(_keys)}, max(seq) AS seq, arg_max(status, seq) AS status FROM health GROUP BY {', '.join(_keys)}",
    )(lambda d, k=_keys: rd.latest_by(health(d), k, "seq"))
q(
    "55_response_by_request",
    "o_orderkey:i, responded_at:t, code:s",
    """SELECT o_orderkey, max(l_shipdate) AS responded_at, max(l_returnflag) AS code FROM orders JOIN (SELECT *, max(l_shipdate) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) ON l_orderkey = o_orderkey
 WHERE l_shipdate = m GROUP BY 1""",
)(
    lambda d: d.table("orders")
    .select("o_orderkey")
    .join(
        rd.latest_by(
            d.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("responded_at"), F.col("l_returnflag").alias("code")),
            ["o_orderkey"],
            "responded_at",
            "code",
        ),
        "o_orderkey",
    )
)
q(
    "56_latest_split_adjusted",
    "security_id:s, as_of:t, quarter_end:t, big:f3",
    "SELECT security_id, as_of, max(quarter_end) AS quarter_end, ln(arg_max(shares, quarter_end)) AS big FROM adjusted_holdings GROUP BY 1, 2",
)(
    lambda d: hd.split_adjusted_holdings(d.holdings, d.actions, Q)
    .groupBy("security_id", "as_of")
    .agg(F.max("quarter_end").alias("quarter_end"), F.ln(F.max_by("shares", "quarter_end")).alias("big"))
)
