"""Trade journal: cleaning, training data, counterfactuals, attribution and model lineage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import finite, ratio
from tidemark.operators.asof import asof_join
from tidemark.operators.reads import latest_by
from tidemark.operators.scans import PIECE, numbered, running_sum, split_large, split_ordered
from tidemark.session import ensure_checkpoint_dir
from tidemark.operators.signals import attach

SECONDS_PER_YEAR = 365.25 * 86400


def clean(records: DataFrame, decisions: DataFrame, provenance: str) -> DataFrame:
    """First matching reason per record. The first record of a trade is found by a minimum, not by sorting a trade's rows.

    ``records``: record_no, trade_id, decision_id, provenance, bar_time, reward, realized_return.
    """
    match = F.col("provenance") == provenance
    first = records.filter(match).groupBy("trade_id").agg(F.min("record_no").alias("first_no"))
    d = decisions.select("decision_id", F.col("decision_time").alias("sample_time"))
    j = records.join(first, "trade_id", "left").join(d, "decision_id", "left")
    rule = (
        F.when(~match, "INVALID:provenance_mismatch")
        .when(F.col("record_no") != F.col("first_no"), "INVALID:duplicate_trade_id")
        .when(F.col("sample_time").isNull(), "UNKNOWN:missing_decision")
        .when(F.col("bar_time") <= F.col("sample_time"), "INVALID:fill_priced_on_decision_bar")
        .when(F.col("reward").isNotNull() & finite("reward").isNull(), "INVALID:invalid_reward_numeric")
        .when(F.col("realized_return").isNotNull() & finite("realized_return").isNull(), "INVALID:invalid_realized_return_numeric")
        .when(F.col("realized_return").isNull(), "EXCLUDED:no_realized_outcome")
        .otherwise("VALID:ok")
    )
    parts = F.split(rule, ":")
    keep = F.when(parts[1].isin("provenance_mismatch", "duplicate_trade_id"), None).otherwise(F.col("sample_time"))
    return j.select("record_no", "trade_id", parts[0].alias("status"), parts[1].alias("reason"), keep.alias("sample_time"), "realized_return")


def before_cutoff(records: DataFrame, decisions: DataFrame, cutoff: Column) -> DataFrame:
    return records.join(decisions.filter(F.col("decision_time") <= cutoff).select("decision_id"), "decision_id", "left_semi")


def training_dataset(cleaned: DataFrame, max_samples: int | None = None, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Valid samples in time order with their split by position. Positions come from a distributed numbering."""
    valid = cleaned.filter(F.col("status") == "VALID").select("trade_id", "sample_time", "realized_return")
    order = ["sample_time", "trade_id"]
    pieces = split_ordered(valid, [], order)
    rows = numbered(pieces, [], order, "position").drop("_piece")
    rows = attach(rows, pieces.agg(F.count(F.lit(1)).alias("all")))
    size = F.col("all") if max_samples is None else F.least("all", F.lit(max_samples))
    place = F.col("position") - (F.col("all") - size)
    n_train = F.floor(size * train)
    split = F.when(place <= n_train, "TRAIN").when(place <= n_train + F.floor(size * validation), "VALIDATION").otherwise("TEST")
    return rows.filter(place > 0).select("trade_id", "sample_time", F.col("realized_return").alias("label"), place.alias("place"), split.alias("split"))


def dataset_version(samples: DataFrame) -> DataFrame:
    """Content hash that needs no order and no list: the sum of row digests and the count, hashed."""
    text = F.concat_ws("|", F.col("trade_id").cast("string"), F.date_format("sample_time", "yyyy-MM-dd HH:mm:ss"))
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    g = samples.agg(F.sum(digest).cast("string").alias("s"), F.count(F.lit(1)).alias("samples"))
    return g.select(F.sha2(F.concat_ws(":", "s", F.col("samples").cast("string")), 256).alias("version"), "samples")


def labels(samples: DataFrame, trades: DataFrame) -> DataFrame:
    """label = realised return; its end = sample time + holding period."""
    t = trades.select("trade_id", "fill_time")
    return samples.join(t, "trade_id").select("trade_id", "label", F.greatest("sample_time", "fill_time").alias("label_end"))


def cash_alternative(rate: float, start: Column, end: Column) -> Column:
    return F.lit(rate) * (F.unix_seconds(end) - F.unix_seconds(start)) / SECONDS_PER_YEAR


def hold_alternative(trades: DataFrame, bars: DataFrame, days: int = 7) -> DataFrame:
    """Price at evaluation over price at decision - 1, each the last close of the days before.

    ``trades``: trade_id, security_id, decision_time, evaluation_time.
    """
    b = bars.select("security_id", F.col("ts").alias("bar_ts"), "close")

    def last_close(df, at, name):
        hit = asof_join(df, b, ["security_id"], at, "bar_ts")
        recent = F.col("bar_ts") >= F.col(at) - F.make_dt_interval(F.lit(days))
        return hit.withColumn(name, F.when(recent, F.col("close"))).drop("bar_ts", "close")

    both = last_close(last_close(trades, "decision_time", "p0"), "evaluation_time", "p1")
    return both.withColumn("hold_return", F.when(F.col("p0") > 0, ratio("p1", "p0") - 1.0))


def alternatives(held: DataFrame, rate: float) -> DataFrame:
    """Array of (name, outcome) per trade."""
    cash = cash_alternative(rate, F.col("decision_time"), F.col("evaluation_time"))
    options = F.array(F.struct(F.lit("CASH").alias("name"), cash.alias("outcome")), F.struct(F.lit("HOLD").alias("name"), F.col("hold_return").alias("outcome")))
    return held.withColumn("alternatives", options)


def append_alternatives(record: Column, extra: Column) -> Column:
    return F.concat(record, extra)


def candidate_alternative(action: Column, hold: Column, cash: Column) -> Column:
    """Outcome under another model's decision: long, negated or cash."""
    return F.when(action == "BUY", hold).when(action == "SELL", -hold).otherwise(cash)


def advantage(realized: Column, alternative: Column) -> Column:
    return realized - alternative


def attribution(experiments: DataFrame) -> DataFrame:
    """Total return split into market, execution (-cost / capital) and the selection left over."""
    execution = -ratio("cost", "capital")
    return experiments.withColumn("execution", execution).withColumn("selection", F.col("total") - F.col("market") - F.col("execution"))


def execution_error(fill: Column, reference: Column) -> Column:
    return ratio(fill - reference, reference)


def promotion(evaluations: DataFrame, min_samples: int, baseline_ratio: float | None = None) -> DataFrame:
    """Checks for the next status; the failed ones are listed in name order.

    ``evaluations``: candidate, to_status, samples, mae, mse, baseline_mae, matches.
    """
    def failed(cond: Column, name: str) -> Column:
        return F.when(~F.coalesce(cond, F.lit(False)), F.lit(name))

    prefix = F.when(F.col("to_status") == "BACKTESTED", "train").when(F.col("to_status") == "VALIDATED", "validation").otherwise("test")
    need = F.when(F.col("to_status") == "BACKTESTED", 1).otherwise(min_samples)
    count_name = F.when(F.col("to_status") == "BACKTESTED", "train_sample_count_positive").otherwise(F.concat(prefix, F.lit("_sample_count_sufficient")))
    checks = [
        F.when(~(F.col("samples") >= need), count_name),
        F.when(finite("mae").isNull(), F.concat(prefix, F.lit("_mae_finite"))),
        F.when(finite("mse").isNull(), F.concat(prefix, F.lit("_mse_finite"))),
    ]
    base = F.array_compact(F.array(*checks))
    if baseline_ratio is not None:
        bar = failed(F.col("mae") <= F.col("baseline_mae") * baseline_ratio, "test_mae_within_baseline_bar")
        known = failed(finite("baseline_mae").isNotNull(), "baseline_mae_finite")
        oos = (F.col("to_status") == "OOS_TESTED") & (F.size(base) == 0)
        base = F.when(oos, F.array_compact(F.array(known, bar))).otherwise(base)
    base = F.when(F.col("matches"), base).otherwise(F.array(F.lit("evaluation_matches_candidate")))
    out = evaluations.withColumn("_failed", F.array_sort(base))
    reason = F.when(F.size("_failed") == 0, "all_criteria_met").otherwise(F.array_join("_failed", ";"))
    return out.withColumn("passed", F.size("_failed") == 0).withColumn("reason", reason).drop("_failed")


def lineage_depth(parents: DataFrame) -> DataFrame:
    """Generation of every model: 0 without a parent, else the parent's + 1. A cycle raises ValueError.

    Pointer doubling: each round joins the models that still have an ancestor ahead with the table and doubles the
    distance covered. Finished models are not joined again.
    """
    ensure_checkpoint_dir(parents.sparkSession)
    state = parents.select("model", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("int").alias("depth")).checkpoint()
    left = state.filter(F.col("up").isNotNull()).count()
    while left:
        above = state.select(F.col("model").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        ahead = state.filter(F.col("up").isNotNull()).join(above, "up", "left")
        ahead = ahead.select("model", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"))
        state = state.filter(F.col("up").isNull()).unionByName(ahead).checkpoint()
        before, left = left, state.filter(F.col("up").isNotNull()).count()
        if left >= before:  # the nearest unfinished model to a root ends in every round, unless there is none
            raise ValueError("the lineage has a cycle")
    return state.select("model", F.col("depth").alias("generation"))


def filtered(rows: DataFrame, **equals) -> DataFrame:
    """Rows matching every given column value; None leaves a column free."""
    out = rows
    for name, value in equals.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def current_status(candidates: DataFrame, transitions: DataFrame) -> DataFrame:
    """Last passed transition per candidate, else CANDIDATE."""
    last = latest_by(transitions.filter(F.col("passed")).select("candidate", "seq", "to_status"), ["candidate"], "seq")
    return candidates.join(last.select("candidate", "to_status"), "candidate", "left").withColumn("status", F.coalesce("to_status", F.lit("CANDIDATE")))


# ---- evaluation ------------------------------------------------------------------------------------------


def error_metrics(samples: DataFrame, *by: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """n, MAE, MSE and mean label over rows with a prediction."""
    e = F.col(label) - F.col(prediction)
    return samples.filter(F.col(prediction).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.avg(label).alias("mean_label")
    )


def evaluate_candidates(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Metrics per candidate and split in one pass, plus a zero baseline on the test split."""
    scored = samples.join(predictions, "trade_id")
    main = error_metrics(scored, "candidate", "split")
    zero = error_metrics(scored.filter(F.col("split") == "TEST").withColumn("prediction", F.lit(0.0)), "candidate")
    return main.unionByName(zero.withColumn("split", F.lit("BASELINE")))


def compare_candidates(evaluations: DataFrame, metric: str = "mae") -> DataFrame:
    """Rank ascending by metric, unknown values last, ties by name. All rows must share one dataset."""
    value = F.coalesce(F.nanvl(F.col(metric), F.lit(float("inf"))), F.lit(float("inf")))
    return evaluations.withColumn("place", F.row_number().over(Window.orderBy(value, "candidate")))


def mean_label(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean label of the train split, the simplest candidate."""
    return samples.filter(F.col("split") == "TRAIN").groupBy(*keys).agg(F.avg("label").alias("prediction"))


def trailing_mean(samples: DataFrame, window: int) -> DataFrame:
    """Mean of the last ``window`` train labels by position."""
    train = samples.filter(F.col("split") == "TRAIN")
    last = attach(train, train.agg(F.max("place").alias("top")))
    return last.filter(F.col("place") > F.col("top") - window).agg(F.avg("label").alias("prediction"), F.count(F.lit(1)).alias("n"))


def replayed_trades(fills: DataFrame, decisions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Journal trades of long positions from fills, with realised profit on the running average cost and the holding period.

    ``fills`` has fill_id, order_id, security_id, side, quantity, price, commission, execution_time; ``decisions`` names
    the decision of each order. Fills whose id is ``stored`` already are not recorded again, but they count for the cost.
    Between two flat positions the cost is affine in what was bought: a sale keeps the share of the cost that it keeps of
    the position. So it is a running sum of purchases, each divided by the share kept up to it; a security with more fills
    than one task can order is summed up in pieces. The fills are shuffled once for all sums, and once for each of the two
    tables that they meet, when they are down to the columns returned.
    """
    group, order = ["security_id"], ["execution_time", "fill_id"]
    done = reduce(DataFrame.unionByName, [_replayed(part, order) for part in split_large(fills, group, order)])
    out = done.join(decisions.select("order_id", "decision_id"), "order_id")
    if stored is not None:
        out = out.join(stored.select("fill_id"), "fill_id", "left_anti")
    return out.select("fill_id", "order_id", "decision_id", "security_id", "side", "position_after", "average_cost", "realized_pnl", "realized_return", "holding_seconds")


def _replayed(fills: DataFrame, order: list[str]) -> DataFrame:
    group, episode = ["security_id"], ["security_id", "episode"]
    buys = F.col("side") == "BUY"
    signed = F.when(buys, F.col("quantity")).otherwise(-F.col("quantity"))
    rows = running_sum(fills, group, order, signed, "position_after").withColumn("position_before", F.col("position_after") - signed)
    opens = (F.abs("position_before") < 1e-9).cast("int")
    rows = running_sum(rows, group, order, opens, "episode")
    kept = F.when(~buys & (F.col("position_after") > 1e-9), F.col("position_after") / F.col("position_before")).otherwise(F.lit(1.0))
    rows = running_sum(rows.withColumn("log_kept", F.ln(kept)), episode, order, F.col("log_kept"), "log_share")
    rows = running_sum(rows, episode, order, F.when(buys, F.col("quantity") * F.col("price") / F.exp("log_share")), "bought")
    if PIECE in rows.columns:
        rows = rows.join(rows.groupBy(*episode).agg(F.min("execution_time").alias("opened_at")), episode)
    else:
        rows = rows.withColumn("opened_at", F.min("execution_time").over(Window.partitionBy(*episode).orderBy(*order)))
    cost = F.exp(F.col("log_share") - F.col("log_kept")) * F.col("bought") / F.col("position_before")  # average before the sale
    basis = F.col("average_cost") * F.col("quantity")
    out = rows.withColumn("average_cost", F.when(~buys, cost))
    out = out.withColumn("realized_pnl", (F.col("price") - F.col("average_cost")) * F.col("quantity") - F.col("commission"))
    out = out.withColumn("realized_return", F.when(basis != 0, F.col("realized_pnl") / basis))
    out = out.withColumn("holding_seconds", F.when(~buys, F.unix_timestamp("execution_time") - F.unix_timestamp("opened_at")))
    return out.select("fill_id", "order_id", "security_id", "side", "position_after", "average_cost", "realized_pnl", "realized_return", "holding_seconds")
