"""Monitoring: metrics per component, health, drift and alerts. All metrics are mergeable aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import finite, ratio
from tidemark.operators.reads import latest_by
from tidemark.operators.scans import previous, split_ordered

# fixed thresholds
MIN_SAMPLES = 5
FAIL_DEGRADED, FAIL_UNAVAILABLE = 0.1, 0.5
INVALID_DEGRADED, INVALID_UNAVAILABLE, STALE_SECONDS = 0.05, 0.25, 2 * 86400
DRIFT_MIN, MEAN_LIMIT, VARIANCE_LIMIT, BUCKETS, DISTANCE_LIMIT = 10, 2.0, 2.0, 5, 0.5
RANKED_HEALTH = ("HEALTHY", "DEGRADED", "UNKNOWN", "UNAVAILABLE")


def share(cond: Column) -> Column:
    """Share of rows meeting the condition."""
    return ratio(F.count_if(cond), F.count(F.lit(1)))


def shares(status: str, values: Sequence[str], suffix: str = "_rate") -> list[Column]:
    return [share(F.col(status) == v).alias(v.lower() + suffix) for v in values]


def bar_metrics(bars: DataFrame, sequence: str = "seq") -> DataFrame:
    """Per security: rows, invalid, duplicate and out-of-order rates, newest available_time."""
    order = [sequence, "ts"]
    pieces = split_ordered(bars, ["security_id"], order)
    stepped = previous(pieces, ["security_id"], order, F.col("ts"), "before")
    bad = F.lit(False)
    for x in ("open", "high", "low", "close", "volume"):
        bad = bad | finite(x).isNull()
    return stepped.groupBy("security_id").agg(
        F.count(F.lit(1)).alias("rows"),
        share(bad).alias("invalid_rate"),
        ratio(F.count(F.lit(1)) - F.countDistinct("ts"), F.count(F.lit(1))).alias("duplicate_rate"),
        share(F.coalesce(F.col("ts") < F.col("before"), F.lit(False))).alias("disorder_rate"),
        F.max("available_time").alias("newest"),
    )


def prediction_metrics(p: DataFrame, *by: str) -> DataFrame:
    return p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col("expected_return").isNull()).alias("missing_rate"),
        F.avg("confidence").alias("mean_confidence"),
        F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("stdev_confidence"),
        F.avg("uncertainty").alias("mean_uncertainty"),
        F.avg("expected_volatility").alias("mean_volatility"),
    )


def action_metrics(d: DataFrame, column: str, values: Sequence[str], *by: str) -> DataFrame:
    """Share of each value of a status or action column."""
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *shares(column, values))


def regime_metrics(r: DataFrame, *by: str) -> DataFrame:
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("trend") == "UNKNOWN").alias("unknown_trend_rate"), share(F.col("stress") == "UNKNOWN").alias("unknown_stress_rate")
    )


def risk_metrics(r: DataFrame, status: str, *by: str) -> DataFrame:
    values = ("PASS", "REDUCE", "REJECT", "UNKNOWN")
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *shares(status, values), share(F.col(status).isin("REJECT", "UNKNOWN")).alias("failure_rate")
    )


def response_metrics(r: DataFrame, *by: str) -> DataFrame:
    """Success and failure rates of service answers by status and error code, duplicate client ids."""
    per_id = r.filter(F.col("client_id").isNotNull()).groupBy(*by, "client_id").agg(F.count(F.lit(1)).alias("c"))
    repeats = per_id.groupBy(*by).agg(F.sum(F.col("c") - 1).alias("duplicates"))
    g = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        share(~F.col("status").isin("ERROR", "UNKNOWN", "REJECTED")).alias("success_rate"),
        share(F.col("status").isin("ERROR", "UNKNOWN", "REJECTED")).alias("failure_rate"),
        share(F.col("error_code") == "timeout").alias("timeout_rate"),
        share(F.col("error_code") == "auth").alias("auth_rate"),
        share(F.col("error_code") == "rate_limit").alias("rate_limit_rate"),
        share(F.col("error_code") == "malformed_response").alias("malformed_rate"),
    )
    return g.join(repeats, list(by), "left")


def account_metrics(nav: DataFrame, initial: float) -> DataFrame:
    g = nav.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "ts").alias("latest"), F.max("value").alias("peak"))
    return g.withColumn("drawdown", F.when(F.col("peak") > 0, ratio(F.col("peak") - F.col("latest"), "peak"))).withColumn("pnl", F.col("latest") - initial)


def gateway_metrics(r: DataFrame, *by: str) -> DataFrame:
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("status") == "SUCCESS").alias("success_rate"), F.avg("attempts").alias("mean_attempts")
    )


def learning_metrics(datasets: DataFrame, evaluations: DataFrame) -> DataFrame:
    from tidemark.operators.signals import attach

    a = datasets.agg(F.count(F.lit(1)).alias("datasets"), F.avg("sample_count").alias("mean_samples"))
    b = evaluations.agg(F.countDistinct("candidate").alias("candidates"), F.avg(F.when(F.col("split") == "TEST", F.col("mae"))).alias("mean_test_mae"))
    return attach(a, b)


def evolution_metrics(transitions: DataFrame, lineage: DataFrame) -> DataFrame:
    from tidemark.operators.signals import attach

    a = transitions.agg(
        F.count(F.lit(1)).alias("transitions"), share(F.col("passed")).alias("pass_rate"), F.count_if(F.col("passed") & (F.col("to_status") == "VALIDATED")).alias("validated")
    )
    b = lineage.agg(F.count("parent").alias("with_parent"))
    return attach(a, b)


# ---- health -----------------------------------------------------------------------------------------


def failure_health(rate: Column, samples: Column) -> Column:
    return (
        F.when(rate.isNull() | (samples < MIN_SAMPLES), "UNKNOWN")
        .when(rate >= FAIL_UNAVAILABLE, "UNAVAILABLE")
        .when(rate >= FAIL_DEGRADED, "DEGRADED")
        .otherwise("HEALTHY")
    )


def existence_health(count: Column) -> Column:
    return F.when(count.isNull() | (count <= 0), "UNKNOWN").otherwise("HEALTHY")


def data_health(invalid: Column, stale_seconds: Column, rows: Column) -> Column:
    return (
        F.when(rows < MIN_SAMPLES, "UNKNOWN")
        .when(invalid >= INVALID_UNAVAILABLE, "UNAVAILABLE")
        .when((stale_seconds > STALE_SECONDS) | (invalid >= INVALID_DEGRADED), "DEGRADED")
        .otherwise("HEALTHY")
    )


def account_health(samples: Column, drawdown: Column, limit: Column) -> Column:
    return (
        F.when((samples < 1) | drawdown.isNull() | limit.isNull(), "UNKNOWN").when(drawdown >= limit, "UNAVAILABLE").otherwise("HEALTHY")
    )


def pipeline_health(components: DataFrame, *by: str) -> DataFrame:
    """Worst status over components (UNAVAILABLE > UNKNOWN > DEGRADED > HEALTHY) and who has it."""
    names = F.array(*[F.lit(s) for s in RANKED_HEALTH])
    rank = F.array_position(names, F.col("status"))
    worst = components.withColumn("_rank", rank).groupBy(*by, "_rank").agg(F.array_sort(F.collect_set("component")).alias("components"))
    top = worst.groupBy(*by).agg(F.max(F.struct("_rank", "components")).alias("r"))
    return top.select(*by, F.element_at(names, F.col("r._rank").cast("int")).alias("status"), F.array_join("r.components", "|").alias("components"))


def known_at(records: DataFrame, time: str, as_of: Column) -> DataFrame:
    return records.filter(F.col(time) <= as_of)


def severity_of(status: Column) -> Column:
    return F.when(status == "UNAVAILABLE", "CRITICAL").when(status.isin("DEGRADED", "UNKNOWN"), "WARNING").otherwise("INFO")


# ---- drift: one table (component, part in {baseline, current}, value) ---------------------------------


def _two(agg, value="value"):
    base, cur = F.when(F.col("part") == "baseline", F.col(value)), F.when(F.col("part") == "current", F.col(value))
    return agg(base), agg(cur)


def mean_shift(values: DataFrame) -> DataFrame:
    nb, nc = _two(F.count)
    mb, mc_ = _two(F.avg)
    sb, _ = _two(F.stddev_samp)
    score = ratio(F.abs(mc_ - mb), sb)
    enough = (nb >= DRIFT_MIN) & (nc >= DRIFT_MIN)
    status = F.when(~enough | score.isNull(), "UNKNOWN").when(score >= MEAN_LIMIT, "DRIFT").otherwise("NO_DRIFT")
    return values.groupBy("component").agg(F.when(enough, score).alias("score"), status.alias("status"))


def variance_shift(values: DataFrame) -> DataFrame:
    nb, nc = _two(F.count)
    vb, vc = _two(F.var_samp)
    score = ratio(vc, vb)
    enough = (nb >= DRIFT_MIN) & (nc >= DRIFT_MIN)
    off = (score >= VARIANCE_LIMIT) | (score <= 1.0 / VARIANCE_LIMIT)
    status = F.when(~enough | score.isNull(), "UNKNOWN").when(off, "DRIFT").otherwise("NO_DRIFT")
    return values.groupBy("component").agg(F.when(enough, score).alias("score"), status.alias("status"))


def distribution_shift(values: DataFrame) -> DataFrame:
    """L1 distance over equal-width buckets of the baseline range, outliers in the end buckets."""
    base = F.when(F.col("part") == "baseline", F.col("value"))
    nb, nc = _two(F.count)
    g = values.groupBy("component").agg(F.min(base).alias("lo"), F.max(base).alias("hi"), nb.alias("nb"), nc.alias("nc"))
    slot = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS)
    b = values.join(g, "component").filter(F.col("hi") > F.col("lo")).withColumn("slot", F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), slot)))
    per = b.groupBy("component", "slot").agg(
        (F.count_if(F.col("part") == "baseline") / F.max("nb")).alias("pb"), (F.count_if(F.col("part") == "current") / F.max("nc")).alias("pc")
    )
    d = per.groupBy("component").agg(F.sum(F.abs(F.coalesce("pb", F.lit(0.0)) - F.coalesce("pc", F.lit(0.0)))).alias("distance"))
    enough = (F.col("nb") >= DRIFT_MIN) & (F.col("nc") >= DRIFT_MIN) & F.col("distance").isNotNull()
    j = g.join(d, "component", "left")
    status = F.when(~enough, "UNKNOWN").when(F.col("distance") >= DISTANCE_LIMIT, "DRIFT").otherwise("NO_DRIFT")
    return j.select("component", F.when(enough, F.col("distance")).alias("score"), status.alias("status"))


# ---- events and alerts --------------------------------------------------------------------------------


def collect_events(rows: DataFrame, metrics: Sequence[Column], status: Column, *by: str) -> DataFrame:
    """One event per component: a map of metrics and the health derived from them."""
    g = rows.groupBy(*by).agg(*metrics)
    return g.withColumn("status", status).withColumn("severity", severity_of(F.col("status")))


def health_alerts(health: DataFrame) -> DataFrame:
    bad = health.filter(F.col("status") != "HEALTHY")
    return bad.select("component", F.lit("health").alias("kind"), severity_of(F.col("status")).alias("severity"))


def drift_alerts(drift: DataFrame) -> DataFrame:
    return drift.filter(F.col("status") != "NO_DRIFT").select("component", F.lit("drift").alias("kind"), F.lit("WARNING").alias("severity"))


def event_alerts(events: DataFrame) -> DataFrame:
    severe = events.filter(F.col("severity").isin("WARNING", "CRITICAL"))
    return severe.select("component", F.lit("event").alias("kind"), "severity")


def pipeline_observation(events: DataFrame, health: DataFrame, drift: DataFrame) -> DataFrame:
    """All alerts of a run, counted by component, kind and severity."""
    parts = [event_alerts(events), health_alerts(health), drift_alerts(drift)]
    return reduce(DataFrame.unionByName, parts).groupBy("component", "kind", "severity").agg(F.count(F.lit(1)).alias("alerts"))


def drift_history(results: DataFrame, component: str, metric: str) -> DataFrame:
    return results.filter((F.col("component") == component) & (F.col("metric") == metric)).orderBy("as_of_time", "seq")


def latest_drift(results: DataFrame) -> DataFrame:
    return latest_by(results, ["component", "metric"], "as_of_time", "seq")
