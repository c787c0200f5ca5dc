"""Share splits and institutional holdings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import c, ratio
from tidemark.operators.asof import facts_on_grid

SPLIT_TYPES = ("SPLIT", "REVERSE_SPLIT")


def parse_ratio(text) -> Column:
    """Number or ``a:b`` text as a ratio; NULL when unreadable or b is 0."""
    parts = F.split(c(text), ":", 2)
    pair = ratio(F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double"))
    return F.coalesce(c(text).try_cast("double"), pair)


def is_share_count_split(value) -> Column:
    """True when the ratio (or its inverse) is p/q with q up to 4, within 0.1 %."""
    up = F.when(c(value) >= 1.0, c(value)).otherwise(ratio(1.0, value))
    near = F.exists(
        F.array(*[F.lit(q) for q in (1, 2, 3, 4)]),
        lambda q: (F.bround(up * q) > q) & (F.abs(up - F.bround(up * q) / q) <= 0.001 * up),
    )
    return F.coalesce(near, F.lit(False))


def splits(actions: DataFrame) -> DataFrame:
    """Split actions as (security_id, effective, split_ratio, known), unreadable or non-positive ratios left out."""
    effective = F.coalesce("effective_time", "event_time")
    out = actions.filter(F.col("action_type").isin(*SPLIT_TYPES)).select(
        "security_id", effective.alias("effective"), parse_ratio("ratio_text").alias("split_ratio"), F.col("available_time").alias("known")
    )
    return out.filter(F.col("effective").isNotNull() & (F.col("split_ratio") > 0))


def split_product(spans: DataFrame, actions: DataFrame, start: str, end: str, keys: Sequence[str]) -> DataFrame:
    """Product of split ratios with start < effective <= end, per key row of ``spans``."""
    s = splits(actions).withColumnRenamed("security_id", "_sec")
    hit = spans.join(s, (F.col("security_id") == F.col("_sec")) & (F.col("effective") > F.col(start)) & (F.col("effective") <= F.col(end)))
    return hit.groupBy(*keys).agg(F.exp(F.sum(F.ln("split_ratio"))).alias("split_factor"))


def split_adjusted_holdings(holdings: DataFrame, actions: DataFrame, grid) -> DataFrame:
    """Each known quarter multiplied by the share-count splits after it that are known by the moment."""
    known = facts_on_grid(holdings, grid, ["security_id", "quarter_end"], ["available_time"])
    s = splits(actions).filter(is_share_count_split("split_ratio")).groupBy(F.col("security_id").alias("_sec"), "effective", "known")
    s = s.agg(F.sum(F.ln("split_ratio")).alias("log_ratio"))  # as many rows as the calendar has days, however many actions
    later = (
        (F.col("security_id") == F.col("_sec"))
        & (F.col("effective") > F.col("quarter_end"))
        & (F.col("effective") <= F.col("as_of"))
        & (F.col("known") <= F.col("as_of"))
    )
    joined = known.join(s, later, "left")
    factor = F.coalesce(F.exp(F.sum("log_ratio")), F.lit(1.0))
    return joined.groupBy("security_id", "as_of", "quarter_end", "shares").agg(factor.alias("factor")).select(
        "security_id", "as_of", "quarter_end", (F.col("shares") * F.col("factor")).alias("shares")
    )
