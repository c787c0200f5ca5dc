"""Feature tables and models. Sums over all samples run on Spark; only systems of a few unknowns are solved outside it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import finite
from tidemark.functions.regression import coefficients, gram_sums
from tidemark.operators.asof import _clamped
from tidemark.operators.fundamental_factors import fact_scores
from tidemark.operators.price_factors import score_factors
from tidemark.operators.signals import attach, forward_return

KEY = ("security_id", "as_of")
PRICE_FEATURES = {"momentum": "long_term_momentum", "low_volatility": "low_volatility"}
FACT_FEATURES = ("roe", "roa", "net_margin", "leverage")
FEATURES = (*PRICE_FEATURES, *FACT_FEATURES)
HORIZON_DAYS = 60
RIDGES = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 500.0, 1000.0)
DEFAULT_RIDGE = 1e-6


def feature_vectors(revisions: DataFrame, facts: DataFrame, grid: Sequence[datetime]) -> DataFrame:
    """Six features per (security, moment); rows with a missing or non-finite one are dropped."""
    prices = score_factors(revisions, grid, list(PRICE_FEATURES.values()))
    prices = prices.select(*KEY, *[F.col(v).alias(k) for k, v in PRICE_FEATURES.items()])
    both = prices.join(fact_scores(facts, grid, FACT_FEATURES), list(KEY))
    return both.select(*KEY, *[finite(x).alias(x) for x in FEATURES]).dropna()


def targets(revisions: DataFrame, grid: Sequence[datetime]) -> DataFrame:
    return forward_return(revisions, grid, HORIZON_DAYS).withColumnRenamed("fwd", "target")


def dataset(revisions: DataFrame, facts: DataFrame, grid: Sequence[datetime]) -> DataFrame:
    """Features with their target and the period the target covers."""
    t = targets(revisions, grid).filter(F.col("target").isNotNull())
    joined = feature_vectors(revisions, facts, grid).join(t, list(KEY))
    return joined.withColumn("target_end", F.col("as_of") + F.make_dt_interval(F.lit(HORIZON_DAYS)))


def training_dates(as_of: datetime, window_months: int, step_months: int = 6) -> list[datetime]:
    """Dates every few months in the window, ending one horizon before the moment so that no label leaks."""
    out, day = [], _clamped(as_of, -window_months)
    while day <= as_of - timedelta(days=HORIZON_DAYS):
        out.append(day)
        day = _clamped(day, step_months)
    return out


def fit_linear(samples: DataFrame, features: Sequence[str] = FEATURES, target: str = "target", ridge: float = DEFAULT_RIDGE) -> DataFrame:
    """One row with the coefficient array, intercept first. The ridge is added to the intercept term as well."""
    return samples.agg(gram_sums(target, list(features)).alias("g"), F.count(F.lit(1)).alias("samples")).select(coefficients("g", ridge).alias("beta"), "samples")


def dot(beta: Column, features: Sequence[str]) -> Column:
    return sum((F.element_at(beta, i + 2) * F.col(x) for i, x in enumerate(features)), F.element_at(beta, 1))


def predict_linear(rows: DataFrame, model: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    return attach(rows, model.select("beta")).withColumn("prediction", dot(F.col("beta"), features)).drop("beta")


def ridge_search(samples: DataFrame, dates: Sequence[datetime], features: Sequence[str] = FEATURES, ridges: Sequence[float] = RIDGES) -> DataFrame:
    """Mean squared error per ridge over three expanding cutoffs, best first.

    Gram sums are additive: one aggregation per date block, running totals for the cutoffs, one solve per
    (cutoff, ridge), then one pass over the samples for the errors.
    """
    days = sorted(dates)
    folds = 3
    cuts = [days[int(len(days) * (i + 1) / (folds + 1))] for i in range(folds)]
    moments = [F.lit(x.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp") for x in cuts]
    block = sum(((F.col("as_of") >= m).cast("int") for m in moments), F.lit(0))
    tagged = samples.withColumn("block", block)
    later = tagged.select("*", F.explode(F.sequence(F.col("block") + 1, F.lit(folds)).alias("x")).alias("fold")).filter(F.col("block") < folds)
    grams = later.groupBy("fold").agg(gram_sums("target", list(features)).alias("g"), F.count(F.lit(1)).alias("n"))
    grid = grams.filter(F.col("n") >= len(features) + 2).select("fold", "g", F.explode(F.array(*[F.lit(r) for r in ridges])).alias("ridge"))
    models = grid.select(F.col("fold").alias("block"), "ridge", coefficients("g", F.col("ridge")).alias("beta"))
    scored = tagged.join(F.broadcast(models), "block")
    error = F.pow(dot(F.col("beta"), features) - F.col("target"), 2)
    return scored.groupBy("ridge").agg(F.avg(error).alias("mse"), F.count(F.lit(1)).alias("n")).orderBy("mse", "ridge")


def fit_on_maps(samples: DataFrame, ids: Sequence[str], ridge: float = DEFAULT_RIDGE) -> DataFrame:
    """Linear fit over samples whose feature map has all ids."""
    whole = F.lit(True)
    for i in ids:
        whole = whole & F.map_contains_key("features", i)
    flat = samples.filter(whole).select(F.col("label"), *[F.col("features")[i].alias(i) for i in ids])
    return fit_linear(flat, ids, "label", ridge)
