"""Signal evaluation: forward returns, information coefficients, overfitting statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normal import normal_cdf, normal_quantile
from tidemark.functions.numeric import average_rank, change, corr_of, fallback_zero, ratio
from tidemark.operators.asof import bars_on_grid

KEY = ("security_id", "as_of")
EULER_GAMMA = 0.5772156649015329


def forward_return(revisions: DataFrame, grid: Sequence[datetime], days: int, flags: DataFrame | None = None) -> DataFrame:
    """First-to-last return over [as_of, as_of + days] as known at the end of it."""
    bars = bars_on_grid(revisions, grid, days, flags, forward=True).withColumn("px", fallback_zero("adjusted_close", "close"))
    first, last = F.min_by("px", "ts"), F.max_by("px", "ts")
    return bars.groupBy(*KEY).agg(F.when((F.count(F.lit(1)) >= 2) & (first > 0), change(last, first)).alias("fwd"))


def ic_series(scores: DataFrame, forward: DataFrame) -> DataFrame:
    """Rank correlation per date over names with both values; dates without one are dropped.

    Twelve decimals are kept so that a correlation of zero is zero and not a rounding error with a sign.
    """
    both = scores.join(forward, list(KEY)).filter(F.col("score").isNotNull() & F.col("fwd").isNotNull())
    ranked = both.select("as_of", average_rank("score", "as_of").alias("rs"), average_rank("fwd", "as_of").alias("rf"))
    return ranked.groupBy("as_of").agg(F.round(corr_of("rs", "rf"), 12).alias("ic"), F.count(F.lit(1)).alias("names")).filter(F.col("ic").isNotNull())


def ic_summary(series: DataFrame) -> DataFrame:
    spread = F.stddev_pop("ic")
    return series.agg(
        F.avg("ic").alias("mean_ic"),
        F.when((F.count("ic") >= 2) & (spread > 0), ratio(F.avg("ic"), spread)).alias("ic_ratio"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"),
        F.count("ic").alias("dates"),
    )


ScoreFn = Callable[[Sequence[datetime]], DataFrame]


def evaluate(score: ScoreFn, revisions: DataFrame, grid: Sequence[datetime], days: int) -> DataFrame:
    """Plug-in point: any function from moments to (security_id, as_of, score) gets an IC series."""
    return ic_series(score(grid), forward_return(revisions, grid, days))


def bucket_returns(passed: DataFrame, forward: DataFrame) -> DataFrame:
    """Mean forward return of passing and failing names per date."""
    both = forward.filter(F.col("fwd").isNotNull()).join(passed, list(KEY), "left")
    ok = F.coalesce("passed", F.lit(False))
    return both.groupBy("as_of").agg(
        F.avg(F.when(ok, F.col("fwd"))).alias("passing"),
        F.count_if(ok).alias("passing_n"),
        F.avg(F.when(~ok, F.col("fwd"))).alias("failing"),
        F.count_if(~ok).alias("failing_n"),
    )


def bucket_summary(buckets: DataFrame) -> DataFrame:
    usable = buckets.dropna(subset=["passing", "failing"]).withColumn("spread", F.col("passing") - F.col("failing"))
    return usable.agg(
        F.avg("passing").alias("mean_passing"),
        F.avg("failing").alias("mean_failing"),
        F.avg("spread").alias("mean_spread"),
        F.avg((F.col("spread") > 0).cast("double")).alias("positive_share"),
        F.count(F.lit(1)).alias("dates"),
    )


def price_matrix(bars: DataFrame, securities: Sequence[str]) -> DataFrame:
    """Wide daily prices, one column per named security."""
    return bars.groupBy("ts").pivot("security_id", list(securities)).agg(F.max("close"))


# ---- overfitting -----------------------------------------------------------------------------------


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row table (an ungrouped aggregate)."""
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one_row.withColumn("_k", F.lit(1))), "_k").drop("_k")


def common_folds(folds: DataFrame, least: int = 6) -> DataFrame:
    """Folds every candidate has, candidates with fewer than ``least`` folds left out first."""
    enough = folds.groupBy("candidate").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("candidate")
    kept = folds.join(enough, "candidate", "left_semi")
    per_fold = kept.groupBy("fold").agg(F.countDistinct("candidate").alias("have"))
    full = attach(per_fold, enough.agg(F.count(F.lit(1)).alias("all"))).filter(F.col("have") == F.col("all"))
    return kept.join(full.select("fold"), "fold", "left_semi")


def cscv_logits(folds: DataFrame, groups: int = 8) -> DataFrame:
    """One row per half-split of the fold groups: the best in-sample candidate and the logit of its rank outside.

    Fold groups are summed first; each (candidate, group) sum is spread over all splits by a projection.
    """
    position = folds.select("fold").distinct().withColumn("pos", F.row_number().over(Window.orderBy("fold")) - 1)
    sized = attach(position, position.agg(F.count(F.lit(1)).alias("total")))
    grouped = sized.withColumn("g", F.least((F.col("pos") / F.floor(F.col("total") / groups)).cast("int"), F.lit(groups - 1)))
    sums = folds.join(F.broadcast(grouped.select("fold", "g")), "fold").groupBy("candidate", "g").agg(
        F.sum("net_return").alias("s"), F.count(F.lit(1)).alias("n")
    )
    masks = [sum(1 << g for g in chosen) for chosen in combinations(range(groups), groups // 2)]
    spread = sums.select("candidate", "g", "s", "n", F.explode(F.array(*[F.lit(m) for m in masks])).alias("split"))
    inside = F.col("split").bitwiseAND(F.expr("shiftleft(1, g)")) != 0
    perf = spread.groupBy("split", "candidate").agg(
        (F.sum(F.when(inside, F.col("s"))) / F.sum(F.when(inside, F.col("n")))).alias("ins"),
        (F.sum(F.when(~inside, F.col("s"))) / F.sum(F.when(~inside, F.col("n")))).alias("oos"),
    )
    perf = perf.withColumn("ins", F.round("ins", 12)).withColumn("oos", F.round("oos", 12))
    best = F.row_number().over(Window.partitionBy("split").orderBy(F.desc("ins"), "candidate"))
    rank = F.row_number().over(Window.partitionBy("split").orderBy("oos", "candidate"))
    names = F.count(F.lit(1)).over(Window.partitionBy("split"))
    ranked = perf.withColumn("b", best).withColumn("r", rank).withColumn("omega", F.col("r") / (names + 1)).filter(F.col("b") == 1)
    return ranked.select("split", "candidate", F.ln(F.col("omega") / (1 - F.col("omega"))).alias("logit"))


def overfitting_probability(folds: DataFrame, groups: int = 8) -> DataFrame:
    return cscv_logits(folds, groups).agg(
        F.avg((F.col("logit") <= 0).cast("double")).alias("probability"), F.count(F.lit(1)).alias("combinations")
    )


def moments(folds: DataFrame) -> DataFrame:
    """Population moments per candidate: skewness 0 and kurtosis 3 for a constant series."""
    return folds.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.avg("net_return"), F.stddev_pop("net_return")).alias("sharpe"),
        F.coalesce(F.skewness("net_return"), F.lit(0.0)).alias("skew"),
        F.coalesce(F.kurtosis("net_return") + 3.0, F.lit(3.0)).alias("kurt"),
    )


def effective_trials(folds: DataFrame) -> DataFrame:
    """n^2 over the sum of squared correlations of all candidate pairs, on the folds that all candidates have.

    No pair is formed: with standardised returns z the squared correlations of all pairs sum up to the squared entries of
    the folds-by-folds matrix of sums z(f) z(g) over the candidates, which are added up where they lie.
    """
    rows = folds.groupBy("candidate", "fold").agg(F.max("net_return").alias("x"))
    n = rows.agg(F.countDistinct("candidate").alias("n"))
    common = attach(rows.groupBy("fold").agg(F.count(F.lit(1)).alias("k")), n).filter(F.col("k") == F.col("n")).select("fold")
    of = Window.partitionBy("candidate")  # a candidate has one row for each fold
    kept = rows.join(common, "fold").withColumn("c", F.col("x") - F.avg("x").over(of))
    size = F.sqrt(F.sum(F.col("c") * F.col("c")).over(of))
    z = kept.select("candidate", "fold", F.when(size > 0, F.col("c") / size).alias("z")).filter(F.col("z").isNotNull())
    vectors = z.groupBy("candidate").agg(F.collect_list(F.struct("fold", "z")).alias("v"))
    cells = vectors.select("v", F.explode("v").alias("f")).select("f", F.explode("v").alias("g"))
    matrix = cells.groupBy(F.col("f.fold").alias("f"), F.col("g.fold").alias("g")).agg(F.sum(F.col("f.z") * F.col("g.z")).alias("s"))
    total = matrix.agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("all"), F.coalesce(F.sum(F.when(F.col("f") == F.col("g"), F.col("s"))), F.lit(0.0)).alias("own"))
    count = F.col("n").cast("double")
    return attach(n, total).select((count * count / (count + F.greatest(F.col("all") - F.col("own"), F.lit(0.0)))).alias("effective"), count.alias("candidates"))


def deflated_sharpe(folds: DataFrame, zero_trials: int = 0, effective: DataFrame | None = None) -> DataFrame:
    """Probability that the Sharpe ratio beats the best expected from noise over all trials.

    ``zero_trials`` counts earlier trials with Sharpe 0; ``effective`` (one row) replaces the trial count.
    """
    m = moments(folds)
    pool = m.agg(F.count(F.lit(1)).alias("k"), F.sum("sharpe").alias("s1"), F.sum(F.col("sharpe") * F.col("sharpe")).alias("s2"))
    trials = F.col("k") + zero_trials
    pool = pool.withColumn("trials", trials.cast("double")).withColumn("var", F.col("s2") / trials - F.pow(F.col("s1") / trials, 2))
    if effective is not None:
        pool = attach(pool, effective.select("effective")).withColumn("count", F.col("effective"))
    else:
        pool = pool.withColumn("count", F.col("trials"))
    inner = F.when(F.col("count") > 1, 1.0 - 1.0 / F.col("count"))
    tail = F.when(F.col("count") > 1, 1.0 - 1.0 / (F.col("count") * F.exp(F.lit(1.0))))
    pool = pool.withColumn("q1", normal_quantile(inner)).withColumn("q2", normal_quantile(tail))
    top = F.sqrt(F.greatest("var", F.lit(0.0))) * ((1 - EULER_GAMMA) * F.col("q1") + EULER_GAMMA * F.col("q2"))
    if effective is not None:
        top = F.greatest(F.lit(0.0), top)
    pool = pool.withColumn("sr0", F.when((F.col("count") <= 1) | (F.col("var") <= 0), 0.0).otherwise(top))
    out = attach(m, pool.select("sr0", "trials"))
    width = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe")))
    z = (F.col("sharpe") - F.col("sr0")) * F.sqrt(F.col("n") - 1) / width
    return out.withColumn("z", z).withColumn("dsr", normal_cdf("z"))


def excess_folds(folds: DataFrame, benchmark: DataFrame) -> DataFrame:
    b = benchmark.select("fold", F.col("net_return").alias("_b"))
    return folds.join(b, "fold").withColumn("net_return", F.col("net_return") - F.col("_b")).drop("_b")


def bootstrap_paths(folds: DataFrame, samples: int, block: float, seed: int) -> DataFrame:
    """Stationary bootstrap: (sample, place, pos) with block starts drawn by MD5, all samples at once."""
    position = folds.select("fold").distinct().withColumn("place", F.row_number().over(Window.orderBy("fold")) - 1)
    sized = attach(position, position.agg(F.count(F.lit(1)).alias("n")))
    many = sized.select("place", "n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))

    def draw(tag: str) -> Column:
        """A number from 0 to 1 made of MD5 digits, the same in any engine."""
        text = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), F.col("sample").cast("string"), F.col("place").cast("string"))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))

    starts = (F.col("place") == 0) | (draw("cut") < 1.0 / block)
    start = F.when(starts, F.struct("place", F.floor(draw("at") * F.col("n")).alias("at")))
    w = Window.partitionBy("sample").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    path = many.withColumn("b", F.last(start, ignorenulls=True).over(w))
    return path.select("sample", "place", "n", F.pmod(F.col("b.at") + F.col("place") - F.col("b.place"), F.col("n")).cast("int").alias("pos"))


def _boot_means(folds: DataFrame, samples: int, block: float, seed: int) -> DataFrame:
    position = folds.select("fold").distinct().withColumn("pos", F.row_number().over(Window.orderBy("fold")) - 1)
    paths = bootstrap_paths(folds, samples, block, seed).groupBy("sample", "pos", "n").agg(F.count(F.lit(1)).alias("times"))
    r = folds.join(F.broadcast(position), "fold")
    return paths.join(r, "pos").groupBy("sample", "candidate").agg(
        (F.sum(F.col("net_return") * F.col("times")) / F.max("n")).alias("boot"), F.max("n").alias("n")
    )


def reality_check(folds: DataFrame, samples: int = 2000, block: float = 4.0, seed: int = 0) -> DataFrame:
    """p-value of the best mean excess return under the stationary bootstrap."""
    means = folds.groupBy("candidate").agg(F.avg("net_return").alias("mean"), F.count(F.lit(1)).alias("m"))
    seen = means.agg((F.max("mean") * F.sqrt(F.max("m"))).alias("observed"), F.max_by("candidate", "mean").alias("best"))
    boot = _boot_means(folds, samples, block, seed).join(means, "candidate")
    stat = boot.groupBy("sample").agg(F.max(F.sqrt("n") * (F.col("boot") - F.col("mean"))).alias("stat"))
    return attach(stat, seen).agg(
        F.avg((F.col("stat") >= F.col("observed")).cast("double")).alias("p_value"), F.max("observed").alias("observed"), F.max("best").alias("best")
    )


def superior_ability(folds: DataFrame, samples: int = 2000, block: float = 4.0, seed: int = 0) -> DataFrame:
    """Studentised, recentred version of the reality check."""
    boot = _boot_means(folds, samples, block, seed)
    width = boot.groupBy("candidate").agg(F.stddev_pop("boot").alias("sd"), F.max("n").alias("n"))
    means = folds.groupBy("candidate").agg(F.avg("net_return").alias("mean"))
    sigma = F.when(F.col("sd") * F.sqrt("n") > 0, F.col("sd") * F.sqrt("n")).otherwise(1e-12)
    s = means.join(width, "candidate").withColumn("sigma", sigma)
    s = s.withColumn("t", F.sqrt("n") * F.col("mean") / F.col("sigma"))
    floor = -F.sqrt(2 * F.ln(F.ln(F.greatest("n", F.lit(3)))) / F.col("n")) * F.col("sigma") / F.sqrt("n")
    s = s.withColumn("centre", F.when(F.col("mean") > floor, F.col("mean")).otherwise(0.0)).drop("n", "sd")
    seen = s.agg(F.max("t").alias("observed"), F.max_by("candidate", "t").alias("best"))
    stat = boot.join(s, "candidate").groupBy("sample").agg(
        F.max(F.sqrt("n") * (F.col("boot") - F.col("centre")) / F.col("sigma")).alias("stat")
    )
    return attach(stat, seen).agg(
        F.avg((F.col("stat") >= F.col("observed")).cast("double")).alias("p_value"), F.max("observed").alias("observed"), F.max("best").alias("best")
    )


# ---- verdicts ---------------------------------------------------------------------------------------

# fixed thresholds of the evidence ladder
MIN_FOLDS_PRELIMINARY = 3
MIN_FOLDS_ROBUST = 6
MIN_POSITIVE_SHARE = 0.6
MIN_REGIMES = 2
MAX_PBO = 0.5
MIN_DSR = 0.95


def evidence_level(real: Column, folds: Column, positive: Column, regimes: Column, applied: Column, pbo: Column, dsr: Column) -> Column:
    """Ladder from INSUFFICIENT_EVIDENCE to CANDIDATE."""
    share = ratio(positive, folds)
    reached = (share >= MIN_POSITIVE_SHARE) & (regimes >= MIN_REGIMES)
    refuted = pbo.isNotNull() & dsr.isNotNull() & ~((pbo < MAX_PBO) & (dsr >= MIN_DSR))
    return (
        F.when(~real | (folds < MIN_FOLDS_PRELIMINARY), "INSUFFICIENT_EVIDENCE")
        .when(folds < MIN_FOLDS_ROBUST, "PRELIMINARY")
        .when(~applied, "ROBUSTNESS_PENDING")
        .when(reached & ~F.coalesce(refuted, F.lit(False)), "CANDIDATE")
        .otherwise("ROBUSTNESS_PENDING")
    )


def overfitting_applicable(folds: DataFrame, min_candidates: int = 2, min_folds: int = 6) -> DataFrame:
    per = folds.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"))
    g = per.agg(F.count(F.lit(1)).alias("candidates"), F.coalesce(F.min("n"), F.lit(0)).alias("least_folds"))
    return g.withColumn("applicable", (F.col("candidates") >= min_candidates) & (F.col("least_folds") >= min_folds))


def candidate_class(criteria: Sequence[Column], real: Column, rejection: Column) -> Column:
    met = F.lit(True)
    for x in criteria:
        met = met & F.coalesce(x, F.lit(False))
    return F.when(rejection.isNotNull(), "REJECTED").when(real & met, "PROMISING_CANDIDATE").otherwise("INCONCLUSIVE")


def exam_verdict(cagr: Column, base_cagr: Column, sharpe: Column, base_sharpe: Column) -> Column:
    return F.when((cagr > base_cagr) & (sharpe > base_sharpe), "PASS").otherwise("FAIL")


def verdict_against_hold(valid: Column, base_valid: Column, verdict: Column) -> Column:
    return F.when(valid & base_valid, verdict).otherwise("INVALID")
