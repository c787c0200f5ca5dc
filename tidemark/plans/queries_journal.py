"""Journal, learning data and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import journal as jr
from tidemark.operators import monitoring as mn
from tidemark.operators import scoring as sc
from tidemark.operators import signals as sg
from tidemark.plans.domain import Domain
from tidemark.plans.oracle import VIEWS
from tidemark.plans.queries_performance import nav
from tidemark.plans.queries_quality import faulty
from tidemark.plans.queries_reads import analyses, experience, health, predictions, regimes
from tidemark.plans.queries_regime import book, composite
from tidemark.plans.registry import query

VIEWS["records"] = """SELECT l_orderkey * 8 + l_linenumber + l_partkey * 1000000 AS record_no, l_orderkey AS trade_id, CASE WHEN l_orderkey % 19 = 0 THEN -1 ELSE l_orderkey END AS decision_id,
 CASE WHEN l_returnflag = 'R' THEN 'PAPER' ELSE 'REAL' END AS provenance, l_shipdate AS bar_time, CASE WHEN l_partkey % 23 = 0 THEN 'nan'::DOUBLE ELSE l_discount END AS reward,
 CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_discount - l_tax END AS realized_return FROM lineitem"""
VIEWS["cleaned"] = """SELECT record_no, r.trade_id, split_part(rule, ':', 1) AS status, split_part(rule, ':', 2) AS reason, CASE WHEN rule LIKE '%mismatch' OR rule LIKE '%duplicate%' THEN NULL ELSE decision_time END AS sample_time, realized_return FROM (
 SELECT r.*, decision_time, CASE WHEN r.provenance <> 'REAL' THEN 'INVALID:provenance_mismatch' WHEN record_no <> first_no THEN 'INVALID:duplicate_trade_id' WHEN decision_time IS NULL THEN 'UNKNOWN:missing_decision'
 WHEN bar_time <= decision_time THEN 'INVALID:fill_priced_on_decision_bar' WHEN isnan(reward) THEN 'INVALID:invalid_reward_numeric' WHEN realized_return IS NULL THEN 'EXCLUDED:no_realized_outcome' ELSE 'VALID:ok' END AS rule
 FROM records r LEFT JOIN (SELECT trade_id, min(record_no) AS first_no FROM records WHERE provenance = 'REAL' GROUP BY 1) f ON f.trade_id = r.trade_id LEFT JOIN decisions d ON d.decision_id = r.decision_id) r"""


def records(d: Domain):
    k = F.col("l_orderkey")
    return d.table("lineitem").select(
        (k * 8 + F.col("l_linenumber") + F.col("l_partkey") * 1000000).alias("record_no"),
        k.alias("trade_id"),
        F.when(k % 19 == 0, F.lit(-1)).otherwise(k).alias("decision_id"),
        F.when(F.col("l_returnflag") == "R", "PAPER").otherwise("REAL").alias("provenance"),
        F.col("l_shipdate").alias("bar_time"),
        F.when(F.col("l_partkey") % 23 == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("reward"),
        F.when(F.col("l_suppkey") % 11 != 0, F.col("l_discount") - F.col("l_tax")).alias("realized_return"),
    )


def cleaned(d: Domain):
    return jr.clean(records(d), d.decisions, "REAL")


_PLACED = """SELECT trade_id, sample_time, label, place, CASE WHEN place <= floor(n * 0.6::DOUBLE) THEN 'TRAIN' WHEN place <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'VALIDATION' ELSE 'TEST' END AS split FROM (
 SELECT *, position - (total - n) AS place FROM (SELECT trade_id, sample_time, realized_return AS label, row_number() OVER (ORDER BY sample_time, trade_id) AS position, count(*) OVER () AS total, count(*) OVER () AS n FROM cleaned WHERE status = 'VALID')) WHERE place > 0"""
VIEWS["samples"] = _PLACED


def samples(d: Domain):
    return jr.training_dataset(cleaned(d))


CL = "record_no:i, trade_id:i, status:s, reason:s, sample_time:t"
query("jrn_01_clean", CL, "SELECT * FROM cleaned")(cleaned)
query("jrn_02_cutoff", "record_no:i, trade_id:i", "SELECT record_no, trade_id FROM records WHERE decision_id IN (SELECT decision_id FROM decisions WHERE decision_time <= TIMESTAMP '1998-01-01')")(
    lambda d: jr.before_cutoff(records(d), d.decisions, F.lit("1998-01-01").cast("timestamp"))
)
query("jrn_03_training_dataset", "trade_id:i, sample_time:t, label:f, place:i, split:s", "SELECT * FROM samples")(samples)
query(
    "jrn_03_dataset_version",
    "version:s, samples:i",
    """SELECT sha256(CAST(CAST(sum(CAST('0x' || substr(sha256(CAST(trade_id AS VARCHAR) || '|' || strftime(sample_time, '%Y-%m-%d %H:%M:%S')), 1, 12) AS BIGINT)) AS HUGEINT) AS VARCHAR) || ':' || CAST(count(*) AS VARCHAR)) AS version, count(*) AS samples FROM samples""",
)(lambda d: jr.dataset_version(samples(d)))
query("jrn_04_labels", "trade_id:i, label:f, label_end:t", "SELECT trade_id, label, greatest(sample_time, fill_time) AS label_end FROM samples JOIN trades USING (trade_id)")(
    lambda d: jr.labels(samples(d), d.trades)
)
VIEWS["held"] = """SELECT trade_id, t.security_id, decision_time, fill_time + INTERVAL 30 DAY AS evaluation_time, realized_return, action,
 (SELECT arg_max(close, ts) FROM bars b WHERE b.security_id = t.security_id AND ts <= decision_time AND ts >= decision_time - INTERVAL 7 DAY) AS p0,
 (SELECT arg_max(close, ts) FROM bars b WHERE b.security_id = t.security_id AND ts <= fill_time + INTERVAL 30 DAY AND ts >= fill_time + INTERVAL 23 DAY) AS p1
 FROM trades t JOIN decisions USING (decision_id)"""
VIEWS["alts"] = "SELECT *, p1 / p0 - 1 AS hold, 0.02::DOUBLE * date_diff('second', decision_time, evaluation_time) / (365.25::DOUBLE * 86400) AS cash FROM held"


def held(d: Domain):
    t = d.trades.join(d.decisions.select("decision_id", "decision_time", "action"), "decision_id")
    t = t.select("trade_id", "security_id", "decision_time", (F.col("fill_time") + F.expr("INTERVAL '30' DAY")).alias("evaluation_time"), "realized_return", "action")
    return jr.hold_alternative(t, d.bars)


def _cash():
    return jr.cash_alternative(0.02, F.col("decision_time"), F.col("evaluation_time"))


query("jrn_05_cash_alternative", "trade_id:i, cash:f", "SELECT trade_id, cash FROM alts")(lambda d: held(d).withColumn("cash", _cash()))
query("jrn_06_hold_alternative", "trade_id:i, p0:f, p1:f, hold_return:f", "SELECT trade_id, p0, p1, hold AS hold_return FROM alts")(held)
query("jrn_07_alternatives", "trade_id:i, name:s, outcome:f", "SELECT trade_id, 'CASH' AS name, cash AS outcome FROM alts UNION ALL SELECT trade_id, 'HOLD', hold FROM alts")(
    lambda d: jr.alternatives(held(d), 0.02).select("trade_id", F.inline("alternatives"))
)
query("jrn_08_advantage", "trade_id:i, gain:f", "SELECT trade_id, realized_return - hold AS gain FROM alts")(
    lambda d: held(d).select("trade_id", jr.advantage(F.col("realized_return"), F.col("hold_return")).alias("gain"))
)
query("jrn_09_candidate_alternative", "trade_id:i, outcome:f", "SELECT trade_id, CASE action WHEN 'BUY' THEN hold WHEN 'SELL' THEN -hold ELSE cash END AS outcome FROM alts")(
    lambda d: held(d).select("trade_id", jr.candidate_alternative(F.col("action"), F.col("hold_return"), _cash()).alias("outcome"))
)
query("jrn_24_append_alternatives", "trade_id:i, n:i, last:f", "SELECT trade_id, 3 AS n, CASE action WHEN 'BUY' THEN hold WHEN 'SELL' THEN -hold ELSE cash END AS last FROM alts")(
    lambda d: jr.alternatives(held(d), 0.02)
    .withColumn(
        "all",
        jr.append_alternatives(
            F.col("alternatives"),
            F.array(F.struct(F.lit("CANDIDATE").alias("name"), jr.candidate_alternative(F.col("action"), F.col("hold_return"), _cash()).alias("outcome"))),
        ),
    )
    .select("trade_id", F.size("all").alias("n"), F.element_at("all", -1)["outcome"].alias("last"))
)


def experiments(d: Domain):
    g = d.trades.groupBy("security_id").agg(F.sum("realized_pnl").alias("pnl"), F.sum(sc.commission(F.col("quantity"))).alias("cost"), F.sum(F.col("quantity") * F.col("fill_price")).alias("capital"), F.avg("realized_return").alias("market"))
    return g.withColumn("total", F.col("pnl") / F.col("capital"))


_EXP = "(SELECT security_id, sum(realized_pnl) / sum(quantity * fill_price) AS total, sum(1.0::DOUBLE + 0.005::DOUBLE * quantity) AS cost, sum(quantity * fill_price) AS capital, avg(realized_return) AS market FROM trades GROUP BY 1)"
query("jrn_10_attribution", "security_id:s, total:f, market:f, execution:f10, selection:f", f"SELECT *, -cost / capital AS execution, total - market + cost / capital AS selection FROM {_EXP}")(lambda d: jr.attribution(experiments(d)))
query("jrn_12_execution_attribution", "security_id:s, execution:f10", f"SELECT security_id, -cost / capital AS execution FROM {_EXP}")(lambda d: jr.attribution(experiments(d)))
query("jrn_11_execution_error", "trade_id:i, err:f", "SELECT trade_id, (p0 + realized_return - p0) / p0 AS err FROM held")(
    lambda d: held(d).select("trade_id", jr.execution_error(F.col("p0") + F.col("realized_return"), F.col("p0")).alias("err"))
)
VIEWS["evals"] = """SELECT security_id AS candidate, ['BACKTESTED', 'VALIDATED', 'OOS_TESTED'][c + 1] AS to_status, c, count(*) AS samples, avg(abs(realized_return)) AS mae, CASE WHEN count(*) % 9 = 0 THEN NULL ELSE avg(realized_return * realized_return) END AS mse,
 avg(abs(realized_return)) * 1.1::DOUBLE - 0.002::DOUBLE AS baseline_mae, count(*) % 7 <> 0 AS matches FROM (SELECT *, trade_id % 3 AS c FROM trades) GROUP BY 1, 2, 3"""


def evals(d: Domain):
    t = d.trades.withColumn("c", (F.col("trade_id") % 3).cast("int"))
    g = t.groupBy(F.col("security_id").alias("candidate"), "c").agg(
        F.count(F.lit(1)).alias("samples"), F.avg(F.abs("realized_return")).alias("mae"), F.avg(F.col("realized_return") * F.col("realized_return")).alias("mse0")
    )
    status = F.element_at(F.array(F.lit("BACKTESTED"), F.lit("VALIDATED"), F.lit("OOS_TESTED")), F.col("c") + 1)
    return g.select(
        "candidate", "c", status.alias("to_status"), "samples", "mae", F.when(F.col("samples") % 9 != 0, F.col("mse0")).alias("mse"),
        (F.col("mae") * 1.1 - 0.002).alias("baseline_mae"), (F.col("samples") % 7 != 0).alias("matches"),
    )


VIEWS["transitions"] = """SELECT *, reason = 'all_criteria_met' AS passed FROM (SELECT candidate, c AS seq, to_status, CASE WHEN NOT matches THEN 'evaluation_matches_candidate'
 WHEN samples < CASE c WHEN 0 THEN 1 ELSE 195 END OR mse IS NULL THEN concat_ws(';', CASE WHEN mse IS NULL THEN ['train', 'validation', 'test'][c + 1] || '_mse_finite' END, CASE WHEN samples < CASE c WHEN 0 THEN 1 ELSE 195 END THEN ['train_sample_count_positive', 'validation_sample_count_sufficient', 'test_sample_count_sufficient'][c + 1] END)
 WHEN c = 2 AND NOT (mae <= baseline_mae) THEN 'test_mae_within_baseline_bar' ELSE 'all_criteria_met' END AS reason FROM evals)"""


def transitions(d: Domain):
    return jr.promotion(evals(d), 195, 1.0).withColumn("seq", F.col("c"))


query("jrn_13_promotion", "candidate:s, to_status:s, passed:b, reason:s", "SELECT * FROM transitions")(transitions)
query(
    "jrn_22_current_status",
    "candidate:s, status:s",
    "SELECT candidate, coalesce(arg_max(CASE WHEN passed THEN to_status END, CASE WHEN passed THEN seq END), 'CANDIDATE') AS status FROM transitions GROUP BY 1",
)(lambda d: jr.current_status(evals(d).select("candidate").distinct(), transitions(d)))
VIEWS["lineage"] = "SELECT o_orderkey AS model, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey - 1 END AS parent FROM orders"


def lineage(d: Domain):
    k = F.col("o_orderkey")
    return d.table("orders").select(k.alias("model"), F.when(k % 10 != 0, k - 1).alias("parent"))


query(
    "jrn_14_lineage_depth",
    "model:i, generation:i",
    "WITH RECURSIVE g(model, generation) AS (SELECT model, 0 FROM lineage WHERE parent IS NULL UNION ALL SELECT l.model, generation + 1 FROM lineage l JOIN g ON l.parent = g.model) SELECT * FROM g",
)(lambda d: jr.lineage_depth(lineage(d)))
query("jrn_23_children", "model:i, parent:i", "SELECT * FROM lineage WHERE parent IN (SELECT model FROM lineage WHERE parent IS NULL)")(
    lambda d: lineage(d).join(lineage(d).filter(F.col("parent").isNull()).select(F.col("model").alias("parent")), "parent", "left_semi")
)
query("jrn_15_list_trades", "trade_id:i, fill_time:t", "SELECT trade_id, fill_time FROM trades WHERE security_id = 'Brand#3' AND fill_time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-01-01'")(
    lambda d: jr.filtered(d.trades, security_id="Brand#3").filter(F.col("fill_time").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1999-01-01").cast("timestamp"))).orderBy("fill_time")
)
query("jrn_16_list_decisions", "decision_id:i, decision_time:t", "SELECT decision_id, decision_time FROM decisions WHERE security_id = 'Brand#3' AND provenance = 'REAL'")(
    lambda d: jr.filtered(d.decisions, security_id="Brand#3", provenance="REAL").orderBy("decision_time")
)
query("jrn_17_analysis_history", "trade_id:i, seq:i, error:f", "SELECT * FROM analyses")(lambda d: analyses(d).orderBy("trade_id", "seq"))
query("jrn_18_corrections", "trade_id:i, seq:i, error:f", "SELECT a.* FROM analyses a JOIN (SELECT trade_id, min(seq) AS f FROM analyses GROUP BY 1) b ON a.trade_id = b.trade_id AND seq > f")(
    lambda d: analyses(d).join(analyses(d).groupBy("trade_id").agg(F.min("seq").alias("f")), "trade_id").filter(F.col("seq") > F.col("f"))
)
query("jrn_19_record_experience", "trade_id:i", "SELECT trade_id FROM experience WHERE trade_id NOT IN (SELECT trade_id FROM samples)")(
    lambda d: experience(d).select("trade_id").distinct().join(samples(d).select("trade_id"), "trade_id", "left_anti")
)
query("jrn_20_list_regimes", "security_id:s, regime_time:t, trend:s", "SELECT * FROM regimes WHERE security_id = 'Brand#5' AND volatility = 'HIGH'")(
    lambda d: jr.filtered(regimes(d), security_id="Brand#5", volatility="HIGH").orderBy("regime_time")
)
query("jrn_21_list_predictions", "security_id:s, prediction_time:t, prediction_id:i", "SELECT * FROM predictions WHERE status = 'COMPLETED' AND security_id = 'Brand#5'")(
    lambda d: jr.filtered(predictions(d), security_id="Brand#5", status="COMPLETED").orderBy("prediction_time", "prediction_id")
)

# ---- evaluation of candidates ---------------------------------------------------------------------------------
VIEWS["cand_pred"] = "SELECT trade_id, 'm' || CAST(k AS VARCHAR) AS candidate, CASE WHEN (trade_id + k) % 5 <> 0 THEN round((trade_id % 11) * 0.01::DOUBLE - 0.05::DOUBLE * k, 6) END AS prediction FROM trades, (SELECT unnest([0, 1, 2]) AS k)"


def candidate_predictions(d: Domain):
    t = d.trades.select("trade_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    value = F.round((F.col("trade_id") % 11) * 0.01 - F.lit(0.05) * F.col("k"), 6)
    return t.select("trade_id", F.concat(F.lit("m"), F.col("k").cast("string")).alias("candidate"), F.when((F.col("trade_id") + F.col("k")) % 5 != 0, value).alias("prediction"))


_MET = "count(*) AS n, avg(abs(label - prediction)) AS mae, avg((label - prediction) * (label - prediction)) AS mse, avg(label) AS mean_label"
VIEWS["cand_eval"] = f"""SELECT candidate, split, {_MET} FROM samples JOIN cand_pred USING (trade_id) WHERE prediction IS NOT NULL GROUP BY 1, 2
 UNION ALL SELECT candidate, 'BASELINE', count(*), avg(abs(label)), avg(label * label), avg(label) FROM samples JOIN cand_pred USING (trade_id) WHERE split = 'TEST' GROUP BY 1"""


def candidate_evaluations(d: Domain, known=None):
    return jr.evaluate_candidates(samples(d) if known is None else known, candidate_predictions(d))


EV = "n:i, mae:f, mse:f, mean_label:f"
query("agg_35_error_metrics", f"candidate:s, {EV}", f"SELECT candidate, {_MET} FROM samples JOIN cand_pred USING (trade_id) WHERE prediction IS NOT NULL GROUP BY 1")(
    lambda d: jr.error_metrics(samples(d).join(candidate_predictions(d), "trade_id"), "candidate")
)
query("agg_39_evaluate", f"split:s, {EV}", "SELECT split, n, mae, mse, mean_label FROM cand_eval WHERE candidate = 'm1'")(
    lambda d: jr.evaluate_candidates(samples(d), candidate_predictions(d).filter(F.col("candidate") == "m1"))
)
query("agg_40_evaluate_batch", f"candidate:s, split:s, {EV}", "SELECT * FROM cand_eval")(candidate_evaluations)
query("agg_36_compare_candidates", "candidate:s, mae:f, place:i", "SELECT candidate, mae, row_number() OVER (ORDER BY mae, candidate) AS place FROM cand_eval WHERE split = 'TEST'")(
    lambda d: jr.compare_candidates(candidate_evaluations(d).filter(F.col("split") == "TEST"))
)
query("ml_12_mean_label", "prediction:f", "SELECT avg(label) AS prediction FROM samples WHERE split = 'TRAIN'")(lambda d: jr.mean_label(samples(d)))
query("ml_13_trailing_mean", "prediction:f, n:i", "SELECT avg(label) AS prediction, count(*) AS n FROM samples WHERE split = 'TRAIN' AND place > (SELECT max(place) FROM samples WHERE split = 'TRAIN') - 250")(
    lambda d: jr.trailing_mean(samples(d), 250)
)

# ---- monitoring ------------------------------------------------------------------------------------------------
_RATE = "count(*) FILTER (WHERE {}) / count(*)"
VIEWS["bar_metrics"] = """SELECT security_id, count(*) AS rows, count(*) FILTER (WHERE NOT isfinite(volume + close)) / count(*) AS invalid_rate, (count(*) - count(DISTINCT ts)) / count(*) AS duplicate_rate, count(*) FILTER (WHERE ts < b) / count(*) AS disorder_rate, max(available_time) AS newest
 FROM (SELECT *, lag(ts) OVER (PARTITION BY security_id ORDER BY seq, ts) AS b FROM faulty_revisions) GROUP BY 1"""


def bar_metrics(d: Domain):
    return mn.bar_metrics(faulty(d))


query("mon_01_bar_metrics", "security_id:s, rows:i, invalid_rate:f, duplicate_rate:f, disorder_rate:f, newest:t", "SELECT * FROM bar_metrics")(bar_metrics)
query(
    "mon_02_prediction_metrics",
    "security_id:s, n:i, missing_rate:f, mean_confidence:f, stdev_confidence:f, mean_uncertainty:f, mean_volatility:f",
    f"""SELECT security_id, count(*) AS n, {_RATE.format('expected_return IS NULL')} AS missing_rate, avg(confidence) AS mean_confidence, stddev_samp(confidence) AS stdev_confidence,
 avg(uncertainty) AS mean_uncertainty, avg(expected_volatility) AS mean_volatility FROM book GROUP BY 1""",
)(lambda d: mn.prediction_metrics(book(d), "security_id"))
_ACTS = ("BUY", "HOLD", "SELL", "NO_TRADE")
query(
    "mon_03_decision_metrics",
    "security_id:s, n:i, buy_rate:f, hold_rate:f, sell_rate:f, no_trade_rate:f",
    "SELECT security_id, count(*) AS n, " + ", ".join(_RATE.format(f"act = '{a}'") + f" AS {a.lower()}_rate" for a in _ACTS) + " FROM decided GROUP BY 1",
)(lambda d: mn.action_metrics(sc.decide(book(d)), "decision_action", _ACTS, "security_id"))
query(
    "mon_04_regime_metrics",
    "as_of:t, n:i, unknown_trend_rate:f, unknown_stress_rate:f",
    f"SELECT as_of, count(*) AS n, {_RATE.format(chr(116) + 'rend = ' + repr('UNKNOWN'))} AS unknown_trend_rate, {_RATE.format('stress = ' + repr('UNKNOWN'))} AS unknown_stress_rate FROM rg_all GROUP BY 1",
)(lambda d: mn.regime_metrics(composite(d), "as_of"))
_STAT = ("PASS", "REDUCE", "REJECT", "UNKNOWN")


def _status_sql(source: str, col: str) -> str:
    return "SELECT security_id, count(*) AS n, " + ", ".join(_RATE.format(f"{col} = '{s}'") + f" AS {s.lower()}_rate" for s in _STAT) + f", {_RATE.format(col + ' IN ' + repr(('REJECT', 'UNKNOWN')))} AS failure_rate FROM {source} GROUP BY 1"


ST = "security_id:s, n:i, pass_rate:f, reduce_rate:f, reject_rate:f, unknown_rate:f"
query("mon_05_sizing_metrics", ST, _status_sql("sized", "size_status"))(lambda d: mn.action_metrics(sc.size(sc.decide(book(d))), "size_status", _STAT, "security_id"))
query("mon_06_risk_metrics", ST + ", failure_rate:f", _status_sql("(SELECT *, split_part(verdict, ':', 1) AS vs FROM assessed)", "vs"))(
    lambda d: mn.risk_metrics(sc.assess(sc.size(sc.decide(book(d)))), "risk_status", "security_id")
)


def responses(d: Domain):
    e = d.table("events")
    k = F.col("event_id")
    return e.select(
        F.col("event_type").alias("component"),
        F.col("ts"),
        F.when(k % 9 == 0, "ERROR").when(k % 17 == 0, "UNKNOWN").when(k % 23 == 0, "REJECTED").otherwise("SUCCESS").alias("status"),
        F.when(k % 18 == 0, "timeout").when(k % 27 == 0, "auth").when(k % 17 == 0, "rate_limit").when(k % 23 == 0, "malformed_response").alias("error_code"),
        F.col("user_id").alias("client_id"),
        (k % 3 + 1).alias("attempts"),
        "value",
    )


VIEWS["responses"] = """SELECT event_type AS component, ts, CASE WHEN event_id % 9 = 0 THEN 'ERROR' WHEN event_id % 17 = 0 THEN 'UNKNOWN' WHEN event_id % 23 = 0 THEN 'REJECTED' ELSE 'SUCCESS' END AS status,
 CASE WHEN event_id % 18 = 0 THEN 'timeout' WHEN event_id % 27 = 0 THEN 'auth' WHEN event_id % 17 = 0 THEN 'rate_limit' WHEN event_id % 23 = 0 THEN 'malformed_response' END AS error_code, user_id AS client_id, event_id % 3 + 1 AS attempts, value FROM events"""
VIEWS["resp_metrics"] = f"""SELECT component, count(*) AS n, {_RATE.format("status = 'SUCCESS'")} AS success_rate, {_RATE.format("status <> 'SUCCESS'")} AS failure_rate,
 {_RATE.format("error_code = 'timeout'")} AS timeout_rate, {_RATE.format("error_code = 'auth'")} AS auth_rate, {_RATE.format("error_code = 'rate_limit'")} AS rate_limit_rate,
 {_RATE.format("error_code = 'malformed_response'")} AS malformed_rate, count(*) - count(DISTINCT client_id) AS duplicates, avg(attempts) AS mean_attempts FROM responses GROUP BY 1"""


def response_metrics(d: Domain):
    return mn.response_metrics(responses(d), "component")


query("mon_07_response_metrics", "component:s, n:i, success_rate:f, failure_rate:f, timeout_rate:f, auth_rate:f, rate_limit_rate:f, malformed_rate:f, duplicates:i", "SELECT * FROM resp_metrics")(response_metrics)
_ACC = "SELECT grp, n, last_v AS latest, peak, (peak - last_v) / peak AS drawdown, last_v - 100 AS pnl FROM perf JOIN (SELECT grp, max(value) AS peak FROM nav GROUP BY 1) USING (grp)"
query("mon_08_account_metrics", "grp:s, n:i, latest:f, peak:f, drawdown:f, pnl:f", _ACC)(lambda d: mn.account_metrics(nav(d), 100.0))
query("mon_09_gateway_metrics", "component:s, n:i, success_rate:f, mean_attempts:f", "SELECT * FROM resp_metrics")(lambda d: mn.gateway_metrics(responses(d), "component"))


def _learning(d: Domain, known):
    return mn.learning_metrics(known.groupBy("split").agg(F.count(F.lit(1)).alias("sample_count")), candidate_evaluations(d, known))


query(
    "mon_10_learning_metrics",
    "datasets:i, mean_samples:f, candidates:i, mean_test_mae:f",
    "SELECT datasets, mean_samples, candidates, mean_test_mae FROM (SELECT count(*) AS datasets, avg(sample_count) AS mean_samples FROM (SELECT count(*) AS sample_count FROM samples GROUP BY split)), (SELECT count(DISTINCT candidate) AS candidates, avg(CASE WHEN split = 'TEST' THEN mae END) AS mean_test_mae FROM cand_eval)",
)(lambda d: _learning(d, samples(d)))
query(
    "mon_11_evolution_metrics",
    "transitions:i, pass_rate:f, validated:i, with_parent:i",
    "SELECT transitions, pass_rate, validated, with_parent FROM (SELECT count(*) AS transitions, avg(CAST(passed AS INT)) AS pass_rate, count(*) FILTER (WHERE passed AND to_status = 'VALIDATED') AS validated FROM transitions), (SELECT count(parent) AS with_parent FROM lineage)",
)(lambda d: mn.evolution_metrics(transitions(d), lineage(d)))
_FH = "CASE WHEN n < 5 THEN 'UNKNOWN' WHEN rate >= 0.5 THEN 'UNAVAILABLE' WHEN rate >= 0.1 THEN 'DEGRADED' ELSE 'HEALTHY' END"
VIEWS["resp_day"] = "SELECT component, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, count(*) FILTER (WHERE status <> 'SUCCESS') / count(*) AS rate FROM responses GROUP BY 1, 2"
VIEWS["day_health"] = f"SELECT component, day, {_FH} AS status FROM resp_day"


def day_health(d: Domain):
    g = responses(d).groupBy("component", F.date_trunc("day", "ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), mn.share(F.col("status") != "SUCCESS").alias("rate")
    )
    return g.withColumn("status", mn.failure_health(F.col("rate"), F.col("n")))


query("mon_12_failure_health", "component:s, day:t, status:s", "SELECT * FROM day_health")(day_health)
query("mon_13_existence_health", "security_id:s, status:s", "SELECT s.security_id, CASE WHEN n > 0 THEN 'HEALTHY' ELSE 'UNKNOWN' END AS status FROM sector s LEFT JOIN (SELECT security_id, count(*) AS n FROM flags GROUP BY 1) USING (security_id)")(
    lambda d: d.sector.join(d.flags.groupBy("security_id").agg(F.count(F.lit(1)).alias("n")), "security_id", "left").select("security_id", mn.existence_health(F.col("n")).alias("status"))
)
VIEWS["data_health"] = """SELECT security_id, CASE WHEN rows < 5 THEN 'UNKNOWN' WHEN invalid_rate >= 0.25 THEN 'UNAVAILABLE' WHEN date_diff('second', newest, TIMESTAMP '2001-11-06') > 172800 OR invalid_rate >= 0.05 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM bar_metrics"""


def data_health(d: Domain):
    stale = F.unix_seconds(F.lit("2001-11-06").cast("timestamp")) - F.unix_seconds("newest")
    return bar_metrics(d).select("security_id", mn.data_health(F.col("invalid_rate"), stale, F.col("rows")).alias("status"))


query("mon_14_data_health", "security_id:s, status:s", "SELECT * FROM data_health")(data_health)
query("mon_15_account_health", "grp:s, status:s", f"SELECT grp, CASE WHEN grp LIKE '%#1_' THEN 'UNKNOWN' WHEN drawdown >= 0.1 THEN 'UNAVAILABLE' ELSE 'HEALTHY' END AS status FROM ({_ACC})")(
    lambda d: mn.account_metrics(nav(d), 100.0).select("grp", mn.account_health(F.col("n"), F.col("drawdown"), F.when(~F.col("grp").like("%#1_"), 0.1)).alias("status"))
)
query(
    "mon_16_pipeline_health",
    "day:t, status:s, components:s",
    """SELECT day, ['HEALTHY', 'DEGRADED', 'UNKNOWN', 'UNAVAILABLE'][top] AS status, (SELECT string_agg(component, '|' ORDER BY component) FROM day_health h WHERE h.day = t.day AND h.status = ['HEALTHY', 'DEGRADED', 'UNKNOWN', 'UNAVAILABLE'][top]) AS components FROM (
 SELECT day, max(list_position(['HEALTHY', 'DEGRADED', 'UNKNOWN', 'UNAVAILABLE'], status)) AS top FROM day_health GROUP BY 1) t""",
)(lambda d: mn.pipeline_health(day_health(d), "day"))
query("mon_17_known_at", "component:s, n:i", "SELECT component, count(*) AS n FROM health WHERE as_of_time <= TIMESTAMP '2024-01-15' GROUP BY 1")(
    lambda d: mn.known_at(health(d), "as_of_time", F.lit("2024-01-15").cast("timestamp")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
)
_SEV = "CASE status WHEN 'UNAVAILABLE' THEN 'CRITICAL' WHEN 'HEALTHY' THEN 'INFO' ELSE 'WARNING' END"
query("mon_18_severity", "component:s, seq:i, severity:s", f"SELECT component, seq, {_SEV} AS severity FROM health")(lambda d: health(d).select("component", "seq", mn.severity_of(F.col("status")).alias("severity")))
VIEWS["drift_values"] = "SELECT event_type AS component, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'baseline' ELSE 'current' END AS part, CASE WHEN event_type = 'error' AND ts >= TIMESTAMP '2024-01-16' THEN value * 3 + 40 ELSE value END AS value FROM events"


def drift_values(d: Domain):
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    moved = (F.col("event_type") == "error") & ~cut
    return d.table("events").select(F.col("event_type").alias("component"), F.when(cut, "baseline").otherwise("current").alias("part"), F.when(moved, F.col("value") * 3 + 40).otherwise(F.col("value")).alias("value"))


_P = "{}(CASE WHEN part = '{}' THEN value END)"
_b, _c = (lambda f: _P.format(f, "baseline")), (lambda f: _P.format(f, "current"))
VIEWS["drift_mean"] = f"SELECT component, abs({_c('avg')} - {_b('avg')}) / {_b('stddev_samp')} AS score, CASE WHEN score >= 2 THEN 'DRIFT' ELSE 'NO_DRIFT' END AS status FROM drift_values GROUP BY 1"
query("mon_19_mean_shift", "component:s, score:f, status:s", "SELECT * FROM drift_mean")(lambda d: mn.mean_shift(drift_values(d)))
query("mon_20_variance_shift", "component:s, score:f, status:s", f"SELECT component, {_c('var_samp')} / {_b('var_samp')} AS score, CASE WHEN score >= 2 OR score <= 0.5 THEN 'DRIFT' ELSE 'NO_DRIFT' END AS status FROM drift_values GROUP BY 1")(
    lambda d: mn.variance_shift(drift_values(d))
)
query(
    "mon_21_distribution_shift",
    "component:s, score:f, status:s",
    """SELECT component, sum(abs(pb - pc)) AS score, CASE WHEN sum(abs(pb - pc)) >= 0.5 THEN 'DRIFT' ELSE 'NO_DRIFT' END AS status FROM (
 SELECT component, greatest(0, least(4, floor((value - lo) / (hi - lo) * 5))) AS slot, count(*) FILTER (WHERE part = 'baseline') / max(nb) AS pb, count(*) FILTER (WHERE part = 'current') / max(nc) AS pc
 FROM drift_values JOIN (SELECT component, min(CASE WHEN part = 'baseline' THEN value END) AS lo, max(CASE WHEN part = 'baseline' THEN value END) AS hi, count(*) FILTER (WHERE part = 'baseline') AS nb, count(*) FILTER (WHERE part = 'current') AS nc FROM drift_values GROUP BY 1) USING (component) GROUP BY 1, 2) GROUP BY 1""",
)(lambda d: mn.distribution_shift(drift_values(d)))


def events(d: Domain):
    metrics = [F.count(F.lit(1)).alias("n"), mn.share(F.col("status") != "SUCCESS").alias("rate")]
    return mn.collect_events(responses(d), metrics, mn.failure_health(F.col("rate"), F.col("n")), "component")


VIEWS["mon_events"] = f"SELECT *, {_SEV} AS severity FROM (SELECT component, n, failure_rate AS rate, CASE WHEN n < 5 THEN 'UNKNOWN' WHEN failure_rate >= 0.5 THEN 'UNAVAILABLE' WHEN failure_rate >= 0.1 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM resp_metrics)"
query("mon_22_collect", "component:s, n:i, rate:f, status:s, severity:s", "SELECT * FROM mon_events")(events)
_HA = f"SELECT component, 'health' AS kind, {_SEV} AS severity FROM day_health WHERE status <> 'HEALTHY'"
_DA = "SELECT component, 'drift' AS kind, 'WARNING' AS severity FROM drift_mean WHERE status <> 'NO_DRIFT'"
_EA = "SELECT component, 'event' AS kind, severity FROM mon_events WHERE severity <> 'INFO'"
AL = "component:s, kind:s, severity:s"
query("mon_23_pipeline_observation", AL + ", alerts:i", f"SELECT component, kind, severity, count(*) AS alerts FROM ({_HA} UNION ALL {_DA} UNION ALL {_EA}) GROUP BY 1, 2, 3")(
    lambda d: mn.pipeline_observation(events(d), day_health(d), mn.mean_shift(drift_values(d)))
)
query("mon_24_health_alerts", AL, _HA)(lambda d: mn.health_alerts(day_health(d)))
query("mon_25_drift_alerts", AL, _DA)(lambda d: mn.drift_alerts(mn.mean_shift(drift_values(d))))
query("mon_26_event_alerts", AL, _EA)(lambda d: mn.event_alerts(events(d)))
VIEWS["drift_log"] = "SELECT event_type AS component, CASE WHEN user_id % 2 = 0 THEN 'mean' ELSE 'variance' END AS metric, CAST(date_trunc('day', ts) AS TIMESTAMP) AS as_of_time, event_id AS seq, value FROM events"


def drift_log(d: Domain):
    e = d.table("events")
    return e.select(F.col("event_type").alias("component"), F.when(F.col("user_id") % 2 == 0, "mean").otherwise("variance").alias("metric"), F.date_trunc("day", "ts").alias("as_of_time"), F.col("event_id").alias("seq"), "value")


query("mon_27_drift_history", "as_of_time:t, seq:i, value:f", "SELECT * FROM drift_log WHERE component = 'error' AND metric = 'mean'")(lambda d: mn.drift_history(drift_log(d), "error", "mean"))
query(
    "mon_28_latest_drift",
    "component:s, metric:s, seq:i, value:f",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component, metric ORDER BY as_of_time DESC, seq DESC) AS k FROM drift_log) WHERE k = 1",
)(lambda d: mn.latest_drift(drift_log(d)))
