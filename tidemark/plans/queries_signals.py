"""Information coefficients and overfitting statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.normal import normal_cdf, normal_quantile
from tidemark.operators import fundamental_factors as ff
from tidemark.operators import price_factors as pf
from tidemark.operators import signals as sg
from tidemark.operators.panel import padded
from tidemark.plans.domain import MONTHS, QUARTERS, Domain
from tidemark.plans.oracle import VIEWS, forward_sql, normal_cdf_sql, normal_quantile_sql, panel_sql
from tidemark.plans.queries_fundamental import _SQL as FACT_SQL
from tidemark.plans.queries_fundamental import _QUALITY
from tidemark.plans.queries_price import _IND
from tidemark.plans.registry import query

_REV = "CASE WHEN count(*) >= 2 THEN -(arg_max(px, ts) / arg_min(px, ts) - 1) END"


def scores_sql(revisions: str, grid: str) -> str:
    return f"(SELECT security_id, as_of, {_REV} AS score FROM {panel_sql(revisions, grid, padded(21), 22)} GROUP BY 1, 2)"


def ic_sql(scores: str, forward: str) -> str:
    return f"""(SELECT as_of, CASE WHEN count(*) >= 2 AND var_pop(rs) * var_pop(rf) > 0 THEN round(covar_pop(rs, rf) / sqrt(var_pop(rs) * var_pop(rf)), 12) END AS ic, count(*) AS names FROM (
 SELECT as_of, rank() OVER (PARTITION BY as_of ORDER BY score) + (count(*) OVER (PARTITION BY as_of, score) - 1) / 2.0::DOUBLE AS rs,
 rank() OVER (PARTITION BY as_of ORDER BY fwd) + (count(*) OVER (PARTITION BY as_of, fwd) - 1) / 2.0::DOUBLE AS rf
 FROM {scores} s JOIN {forward} f USING (security_id, as_of) WHERE score IS NOT NULL AND fwd IS NOT NULL) GROUP BY 1)"""


_SUMMARY = "SELECT avg(ic) AS mean_ic, avg(ic) / stddev_pop(ic) AS ic_ratio, avg(CAST(ic > 0 AS INT)) AS positive_share, count(ic) AS dates FROM {}"
SCOLS = "mean_ic:f, ic_ratio:f, positive_share:f, dates:i"
IC = "as_of:t, ic:f, names:i"
_FWD_Q = forward_sql("bar_revisions", "grid_q", 60)
VIEWS["ic_m"] = "SELECT * FROM " + ic_sql(scores_sql("region_revisions", "grid_m"), forward_sql("region_revisions", "grid_m", 30))


def reversal(revisions, grid):
    return pf.score_factors(revisions, grid, ["short_term_reversal"]).withColumnRenamed("short_term_reversal", "score")


def monthly_ic(d: Domain):
    """Flagship: short-term reversal against the next 30 days, monthly, on the region grain."""
    return sg.evaluate(lambda grid: reversal(d.region_revisions, grid), d.region_revisions, MONTHS, 30)


query("sig_02_ic_series", IC, "SELECT * FROM ic_m WHERE ic IS NOT NULL")(monthly_ic)
query("sig_02_ic_summary", SCOLS, _SUMMARY.format("ic_m"))(lambda d: sg.ic_summary(monthly_ic(d)))
query("sig_06_summary_quarterly", SCOLS, _SUMMARY.format(ic_sql(scores_sql("bar_revisions", "grid_q"), _FWD_Q)))(
    lambda d: sg.ic_summary(sg.evaluate(lambda g: reversal(d.bar_revisions, g), d.bar_revisions, QUARTERS, 60))
)
query("sig_01_spearman", IC, f"SELECT * FROM {ic_sql(scores_sql('bar_revisions', 'grid_q'), _FWD_Q)} WHERE ic IS NOT NULL")(
    lambda d: sg.ic_series(reversal(d.bar_revisions, QUARTERS), sg.forward_return(d.bar_revisions, QUARTERS, 60))
)


def fact_score(d: Domain, name: str):
    return ff.fact_scores(d.fundamentals, QUARTERS, [name], d.bar_revisions).withColumnRenamed(name, "score")


for _key, _name in (("sig_03_fundamentals_ic", "roe"), ("sig_04_hybrid_ic", "earnings_yield")):
    query(_key, IC, f"SELECT * FROM {ic_sql(f'(SELECT security_id, as_of, {FACT_SQL[_name]} AS score FROM fyp)', _FWD_Q)} WHERE ic IS NOT NULL")(
        lambda d, n=_name: sg.ic_series(fact_score(d, n), sg.forward_return(d.bar_revisions, QUARTERS, 60))
    )
query("sig_05_universe_ic", IC, f"SELECT * FROM {ic_sql(f'({_QUALITY})', _FWD_Q)} WHERE ic IS NOT NULL")(
    lambda d: sg.ic_series(ff.quality_minus_junk(d.fundamentals, QUARTERS), sg.forward_return(d.bar_revisions, QUARTERS, 60))
)
query("udf_02_score_plugin", IC, f"SELECT * FROM {ic_sql(f'(SELECT security_id, as_of, r AS score FROM ({_IND}))', _FWD_Q)} WHERE ic IS NOT NULL")(
    lambda d: sg.evaluate(
        lambda g: pf.score_factors(d.bar_revisions, g, ["industry_return"]).withColumnRenamed("industry_return", "score"), d.bar_revisions, QUARTERS, 60
    )
)
_TREND = f"SELECT security_id, as_of, count(*) >= 2 AND max(CASE WHEN rn = 1 THEN px END) > avg(px) AS passed FROM {panel_sql('bar_revisions', 'grid_q', padded(189), 190)} GROUP BY 1, 2"
VIEWS["buckets"] = f"""SELECT as_of, avg(CASE WHEN passed THEN fwd END) AS passing, count(*) FILTER (WHERE passed) AS passing_n, avg(CASE WHEN NOT passed THEN fwd END) AS failing,
 count(*) FILTER (WHERE NOT passed) AS failing_n FROM (SELECT f.as_of, fwd, coalesce(passed, FALSE) AS passed FROM {_FWD_Q} f LEFT JOIN ({_TREND}) USING (security_id, as_of) WHERE fwd IS NOT NULL) GROUP BY 1"""


def buckets(d: Domain):
    passed = pf.score_factors(d.bar_revisions, QUARTERS, ["trend_gap"]).select("security_id", "as_of", (F.col("trend_gap") > 0).alias("passed"))
    return sg.bucket_returns(passed, sg.forward_return(d.bar_revisions, QUARTERS, 60))


query("udf_04_filter_plugin", "as_of:t, passing:f, passing_n:i, failing:f, failing_n:i", "SELECT * FROM buckets")(buckets)
query(
    "sig_07_bucket_summary",
    "mean_passing:f, mean_failing:f, mean_spread:f, positive_share:f, dates:i",
    """SELECT avg(passing) AS mean_passing, avg(failing) AS mean_failing, avg(passing - failing) AS mean_spread, avg(CAST(passing > failing AS INT)) AS positive_share, count(*) AS dates
 FROM buckets WHERE passing IS NOT NULL AND failing IS NOT NULL""",
)(lambda d: sg.bucket_summary(buckets(d)))
query(
    "sig_08_price_matrix",
    "ts:t, AFRICA:f, ASIA:f",
    "SELECT ts, max(CASE WHEN security_id = 'AFRICA' THEN close END) AS AFRICA, max(CASE WHEN security_id = 'ASIA' THEN close END) AS ASIA FROM bars_region WHERE security_id IN ('AFRICA', 'ASIA') GROUP BY 1",
)(lambda d: sg.price_matrix(d.bars_region.filter(F.col("security_id").isin("AFRICA", "ASIA")), ["AFRICA", "ASIA"]))

VIEWS["common_folds"] = """SELECT * FROM fold_returns WHERE candidate IN (SELECT candidate FROM fold_returns GROUP BY 1 HAVING count(*) >= 6) AND fold IN (
 SELECT fold FROM fold_returns WHERE candidate IN (SELECT candidate FROM fold_returns GROUP BY 1 HAVING count(*) >= 6) GROUP BY fold
 HAVING count(DISTINCT candidate) = (SELECT count(*) FROM (SELECT candidate FROM fold_returns GROUP BY 1 HAVING count(*) >= 6)))"""
VIEWS["cscv"] = """SELECT split, candidate, ln(r / (names + 1) / (1 - r / (names + 1))) AS logit FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ins DESC, candidate) AS b,
 CAST(row_number() OVER (PARTITION BY split ORDER BY oos, candidate) AS DOUBLE) AS r, count(*) OVER (PARTITION BY split) AS names FROM (
 SELECT split, candidate, round(avg(net_return) FILTER (WHERE (split >> g) & 1 = 1), 12) AS ins, round(avg(net_return) FILTER (WHERE (split >> g) & 1 = 0), 12) AS oos FROM (
 SELECT candidate, net_return, least(CAST((dense_rank() OVER (ORDER BY fold) - 1) // ((SELECT count(DISTINCT fold) FROM common_folds) // 8) AS INT), 7) AS g FROM common_folds),
 (SELECT CAST(k AS INT) AS split FROM generate_series(0, 255) t(k) WHERE bit_count(CAST(k AS INT)) = 4) GROUP BY 1, 2)) WHERE b = 1"""


def folds(d: Domain):
    return sg.common_folds(d.fold_returns)


query("set_02_common_folds", "candidate:s, fold:i, net_return:f", "SELECT * FROM common_folds")(folds)
query("sig_09_pbo_logits", "split:i, candidate:s, logit:f", "SELECT * FROM cscv")(lambda d: sg.cscv_logits(folds(d)))
query("sig_09_pbo", "probability:f, combinations:i", "SELECT avg(CAST(logit <= 0 AS INT)) AS probability, count(*) AS combinations FROM cscv")(
    lambda d: sg.overfitting_probability(folds(d))
)
query(
    "sig_10_skewness",
    "candidate:s, skew:f",
    "SELECT candidate, avg(pow(net_return - m, 3)) / pow(stddev_pop(net_return), 3) AS skew FROM (SELECT *, avg(net_return) OVER (PARTITION BY candidate) AS m FROM common_folds) GROUP BY 1",
)(lambda d: sg.moments(folds(d)))
query(
    "sig_11_kurtosis",
    "candidate:s, kurt:f",
    "SELECT candidate, avg(pow(net_return - m, 4)) / pow(stddev_pop(net_return), 4) AS kurt FROM (SELECT *, avg(net_return) OVER (PARTITION BY candidate) AS m FROM common_folds) GROUP BY 1",
)(lambda d: sg.moments(folds(d)))
query(
    "sig_12_effective_trials",
    "effective:f, candidates:i",
    """SELECT n * n / (n + 2 * s) AS effective, n AS candidates FROM (SELECT CAST(count(DISTINCT candidate) AS DOUBLE) AS n FROM common_folds), (SELECT sum(rho * rho) AS s FROM (
 SELECT corr(a.net_return, b.net_return) AS rho FROM common_folds a JOIN common_folds b ON a.fold = b.fold AND a.candidate < b.candidate GROUP BY a.candidate, b.candidate))""",
)(lambda d: sg.effective_trials(folds(d)))
VIEWS["fold_moments"] = """SELECT candidate, count(*) AS n, avg(net_return) / nullif(stddev_pop(net_return), 0) AS sharpe,
 coalesce(avg(pow(net_return - m, 3)) / nullif(pow(stddev_pop(net_return), 3), 0), 0) AS skew, coalesce(avg(pow(net_return - m, 4)) / nullif(pow(stddev_pop(net_return), 4), 0), 3) AS kurt
 FROM (SELECT *, avg(net_return) OVER (PARTITION BY candidate) AS m FROM common_folds) GROUP BY 1"""
_EFFECTIVE = """SELECT n * n / (n + 2 * s) AS effective, n AS candidates FROM (SELECT CAST(count(DISTINCT candidate) AS DOUBLE) AS n FROM common_folds), (SELECT sum(rho * rho) AS s FROM (
 SELECT corr(a.net_return, b.net_return) AS rho FROM common_folds a JOIN common_folds b ON a.fold = b.fold AND a.candidate < b.candidate GROUP BY a.candidate, b.candidate))"""


def _deflated(count: str, zero: int = 0, floor: str = "top") -> str:
    """(candidate, sharpe, sr0, dsr) for a number of trials that is a scalar expression over ``trials``."""
    quantiles = f"{normal_quantile_sql('1 - 1 / count')} AS q1, {normal_quantile_sql('1 - 1 / (count * exp(1.0::DOUBLE))')} AS q2"
    top = f"sqrt(greatest(var, 0)) * ((1 - {sg.EULER_GAMMA}::DOUBLE) * q1 + {sg.EULER_GAMMA}::DOUBLE * q2)"
    z = "(sharpe - sr0) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe))"
    return f"""SELECT candidate, sharpe, sr0, {normal_cdf_sql('z')} AS dsr FROM (SELECT *, {z} AS z FROM fold_moments, (
 SELECT CASE WHEN count <= 1 OR var <= 0 THEN 0 ELSE {floor} END AS sr0 FROM (SELECT *, {top} AS top FROM (SELECT *, {quantiles} FROM (SELECT *, {count} AS count FROM (
 SELECT count(*) + {zero}.0::DOUBLE AS trials, sum(sharpe * sharpe) / (count(*) + {zero}) - pow(sum(sharpe) / (count(*) + {zero}), 2) AS var FROM fold_moments))))))"""


query("sig_13_deflated_sharpe", "candidate:s, sharpe:f, sr0:f, dsr:f", _deflated("trials"))(lambda d: sg.deflated_sharpe(folds(d)))
query("sig_14_cumulative_dsr", "candidate:s, sharpe:f, sr0:f, dsr:f", _deflated("trials", 20))(lambda d: sg.deflated_sharpe(folds(d), zero_trials=20))
query("udf_03_normal_cdf", "candidate:s, p:f, z:f", f"SELECT candidate, p, {normal_quantile_sql('p')} AS z FROM (SELECT candidate, {normal_cdf_sql('sharpe')} AS p FROM fold_moments)")(
    lambda d: sg.moments(folds(d)).select("candidate", normal_cdf("sharpe").alias("p"), normal_quantile(normal_cdf("sharpe")).alias("z"))
)


def excess(d: Domain):
    f = folds(d)
    return sg.excess_folds(f, f.groupBy("fold").agg(F.round(F.avg("net_return"), 12).alias("net_return")))


query(
    "sig_15_excess_returns",
    "candidate:s, fold:i, net_return:f",
    "SELECT candidate, fold, net_return - avg(net_return) OVER (PARTITION BY fold) AS net_return FROM common_folds",
)(excess)
VIEWS["excess_folds"] = "SELECT candidate, fold, net_return - round(avg(net_return) OVER (PARTITION BY fold), 12) AS net_return FROM common_folds"


def _paths(samples: int, seed: int) -> str:
    """Stationary bootstrap written out: each place goes on from the last block start before it."""
    draw = lambda tag: f"CAST(CAST('0x' || substr(md5('{seed}:{tag}:' || sample || ':' || place), 1, 7) AS BIGINT) AS DOUBLE) / {1 << 28}"
    return f"""(SELECT sample, place, n, (b.at + place - b.place) % n AS pos FROM (
 SELECT sample, place, n, last_value(CASE WHEN place = 0 OR {draw('cut')} < 0.25 THEN {{'place': place, 'at': CAST(floor({draw('at')} * n) AS BIGINT)}} END IGNORE NULLS) OVER (PARTITION BY sample ORDER BY place) AS b
 FROM (SELECT row_number() OVER (ORDER BY fold) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT fold FROM common_folds)), range({samples}) t(sample)))"""


VIEWS["boot_means"] = f"""SELECT sample, candidate, avg(net_return) AS boot, max(n) AS n FROM {_paths(2000, 0)} JOIN (
 SELECT *, dense_rank() OVER (ORDER BY fold) - 1 AS pos FROM excess_folds) USING (pos) GROUP BY 1, 2"""
_CHECK = """WITH means AS (SELECT candidate, avg(net_return) AS mean, count(*) AS m FROM excess_folds GROUP BY 1),
 seen AS (SELECT max(mean) * sqrt(max(m)) AS observed, arg_max(candidate, mean) AS best FROM means),
 stat AS (SELECT sample, max(sqrt(n) * (boot - mean)) AS stat FROM boot_means JOIN means USING (candidate) GROUP BY 1)
SELECT avg(CAST(stat >= observed AS INT)) AS p_value, max(observed) AS observed, max(best) AS best FROM stat, seen"""
_SUPERIOR = """WITH width AS (SELECT candidate, stddev_pop(boot) AS sd, max(n) AS n FROM boot_means GROUP BY 1),
 s AS (SELECT candidate, n, mean, CASE WHEN sd * sqrt(n) > 0 THEN sd * sqrt(n) ELSE 1e-12 END AS sigma FROM width JOIN (SELECT candidate, avg(net_return) AS mean FROM excess_folds GROUP BY 1) USING (candidate)),
 c AS (SELECT candidate, sigma, sqrt(n) * mean / sigma AS t, CASE WHEN mean > -sqrt(2 * ln(ln(greatest(n, 3))) / n) * sigma / sqrt(n) THEN mean ELSE 0 END AS centre FROM s),
 seen AS (SELECT max(t) AS observed, arg_max(candidate, t) AS best FROM c),
 stat AS (SELECT sample, max(sqrt(n) * (boot - centre) / sigma) AS stat FROM boot_means JOIN c USING (candidate) GROUP BY 1)
SELECT avg(CAST(stat >= observed AS INT)) AS p_value, max(observed) AS observed, max(best) AS best FROM stat, seen"""
query("sig_16_reality_check", "p_value:f, observed:f, best:s", _CHECK)(lambda d: sg.reality_check(excess(d)))
query("sig_17_superior_ability", "p_value:f, observed:f, best:s", _SUPERIOR)(lambda d: sg.superior_ability(excess(d)))
query("udf_05_bootstrap_paths", "sample:i, place:i, pos:i", f"SELECT sample, place, pos FROM {_paths(200, 7)}")(lambda d: sg.bootstrap_paths(folds(d), 200, 4.0, 7))
query(
    "sig_22_overfitting_report",
    "candidate:s, sharpe:f, dsr:f, probability:f, effective:f",
    f"SELECT candidate, sharpe, dsr, probability, effective FROM ({_deflated(f'(SELECT effective FROM ({_EFFECTIVE}))', floor='greatest(0, top)')}), (SELECT avg(CAST(logit <= 0 AS INT)) AS probability FROM cscv), ({_EFFECTIVE})",
)(
    lambda d: sg.attach(
        sg.attach(sg.deflated_sharpe(folds(d), effective=sg.effective_trials(folds(d))), sg.overfitting_probability(folds(d))),
        sg.effective_trials(folds(d)).select("effective"),
    )
)
VIEWS["fold_stats"] = """SELECT candidate, count(*) AS folds, count(*) FILTER (WHERE net_return > 0) AS positive, avg(net_return) AS mean_r, stddev_pop(net_return) AS sd,
 count(DISTINCT fold % 3) AS regimes FROM fold_returns GROUP BY 1"""


def fold_stats(d: Domain):
    return d.fold_returns.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("folds"),
        F.count_if(F.col("net_return") > 0).alias("positive"),
        F.avg("net_return").alias("mean_r"),
        F.stddev_pop("net_return").alias("sd"),
        F.countDistinct(F.col("fold") % 3).alias("regimes"),
    ).withColumn("number", F.regexp_extract("candidate", r"(\d+)$", 1).cast("int"))


query(
    "sig_18_evidence_level",
    "candidate:s, level:s",
    """SELECT candidate, CASE WHEN n % 7 = 0 OR folds < 3 THEN 'INSUFFICIENT_EVIDENCE' WHEN folds < 6 THEN 'PRELIMINARY' WHEN n % 5 = 0 THEN 'ROBUSTNESS_PENDING'
 WHEN positive / folds >= 0.45 AND regimes >= 2 AND positive / folds >= 0.6 AND NOT (NOT (mean_r < 0.5 AND sd >= 0.95)) THEN 'CANDIDATE' ELSE 'ROBUSTNESS_PENDING' END AS level
 FROM (SELECT *, CAST(regexp_extract(candidate, '([0-9]+)$', 1) AS INT) AS n FROM fold_stats)""",
)(
    lambda d: fold_stats(d).select(
        "candidate",
        sg.evidence_level(
            F.col("number") % 7 != 0, F.col("folds"), F.col("positive"), F.col("regimes"), F.col("number") % 5 != 0, F.col("mean_r"), F.col("sd")
        ).alias("level"),
    )
)
query(
    "sig_19_overfitting_applicable",
    "candidates:i, least_folds:i, applicable:b",
    "SELECT count(*) AS candidates, min(folds) AS least_folds, count(*) >= 2 AND min(folds) >= 6 AS applicable FROM fold_stats",
)(lambda d: sg.overfitting_applicable(d.fold_returns))
query(
    "sig_20_candidate_class",
    "candidate:s, cls:s",
    """SELECT candidate, CASE WHEN n % 6 = 0 THEN 'REJECTED' WHEN n % 4 <> 0 AND mean_r > 0 AND positive > 10 THEN 'PROMISING_CANDIDATE' ELSE 'INCONCLUSIVE' END AS cls
 FROM (SELECT *, CAST(regexp_extract(candidate, '([0-9]+)$', 1) AS INT) AS n FROM fold_stats)""",
)(
    lambda d: fold_stats(d).select(
        "candidate",
        sg.candidate_class(
            [F.col("mean_r") > 0, F.col("positive") > 10], F.col("number") % 4 != 0, F.when(F.col("number") % 6 == 0, F.lit("withdrawn"))
        ).alias("cls"),
    )
)
_BASE = "(SELECT avg(mean_r) AS bm, avg(mean_r / sd) AS bs FROM fold_stats)"


def _exam(d: Domain):
    base = fold_stats(d).agg(F.avg("mean_r").alias("bm"), F.avg(F.col("mean_r") / F.col("sd")).alias("bs"))
    s = sg.attach(fold_stats(d), base)
    return s.withColumn("verdict", sg.exam_verdict(F.col("mean_r"), F.col("bm"), F.col("mean_r") / F.col("sd"), F.col("bs")))


query("sig_21_exam_verdict", "candidate:s, verdict:s", f"SELECT candidate, CASE WHEN mean_r > bm AND mean_r / sd > bs THEN 'PASS' ELSE 'FAIL' END AS verdict FROM fold_stats, {_BASE}")(
    _exam
)
query(
    "sig_23_against_buy_and_hold",
    "candidate:s, outcome:s",
    f"SELECT candidate, CASE WHEN folds < 28 THEN 'INVALID' WHEN mean_r > bm AND mean_r / sd > bs THEN 'PASS' ELSE 'FAIL' END AS outcome FROM fold_stats, {_BASE}",
)(lambda d: _exam(d).select("candidate", sg.verdict_against_hold(F.col("folds") >= 28, F.lit(True), F.col("verdict")).alias("outcome")))
