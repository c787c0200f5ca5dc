"""News event study: sampling, excess returns around a text, rank correlations and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import average_rank, change, corr_of, ratio, rounded_index
from tidemark.operators.scans import numbered, running_sum, split_ordered
from tidemark.operators.signals import attach
from tidemark.session import ensure_checkpoint_dir

# fixed windows of the study
FORWARD_DAYS, MAX_MOVE, DECIDED = 5, 0.5, 0.2
LOT = 1 << 16  #: places of a draw that are picked in one task


def first_per_day(news: DataFrame, symbols: DataFrame) -> DataFrame:
    """First text per (security, day) in file order, universe only; the text is squeezed, never cut."""
    text = F.trim(F.regexp_replace("headline", r"\s+", " "))
    rows = news.join(symbols.select("security_id"), "security_id", "left_semi").withColumn("headline", text).filter(F.col("headline") != "")
    first = rows.groupBy("security_id", "day").agg(F.min("news_id").alias("news_id"))  # no text goes through the aggregation
    return first.join(rows.select("security_id", "day", "news_id", "headline"), ["security_id", "day", "news_id"])


def sample_per_year(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """Equal seeded sample of every year, ordered by the MD5 of seed, security and day."""
    y = rows.withColumn("year", F.year("day"))
    years = y.agg(F.countDistinct("year").alias("_years"))
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), "security_id", F.date_format("day", "yyyy-MM-dd")).cast("binary"))
    k = F.row_number().over(Window.partitionBy("year").orderBy(drawn, "security_id", "day"))
    per = F.greatest(F.lit(1), F.floor(F.lit(size) / F.col("_years")))
    return attach(y.withColumn("k", k), years).filter(F.col("k") <= per).drop("k", "_years")


def adjusted_closes(bars: DataFrame) -> DataFrame:
    """Only bars with an adjusted close that is not 0."""
    return bars.filter(F.col("adjusted_close") != 0).select("security_id", "ts", F.col("adjusted_close").alias("px"))


def calendar(prices: DataFrame) -> DataFrame:
    """Every day any security traded, numbered; one row per day."""
    return prices.select("ts").distinct().withColumn("pos", F.row_number().over(Window.orderBy("ts")) - 1)


def excess_returns(events: DataFrame, prices: DataFrame, horizon: int = FORWARD_DAYS) -> DataFrame:
    """Stock minus equal-weight market over reaction (day before to day after) and forward sessions.

    Market means are computed once per window start; an event joins them by position.
    """
    prices = materialised(prices)  # a row for each security and day, read by every window below
    days = calendar(prices)
    placed = prices.join(F.broadcast(days), "ts").select("security_id", "pos", "px")

    def window(back: int, ahead: int, name: str) -> tuple[DataFrame, DataFrame]:
        start = placed.select("security_id", (F.col("pos") - back).alias("pos"), F.col("px").alias("a"))
        end = placed.select("security_id", (F.col("pos") - ahead).alias("pos"), F.col("px").alias("b"))
        r = start.join(end, ["security_id", "pos"]).filter(F.col("a") > 0).select("security_id", "pos", change("b", "a").alias(name))
        return r, r.groupBy("pos").agg(F.avg(name).alias(f"{name}_market"))

    # each session also stands for the closed days before it
    gap = F.date_add(F.to_date(F.lag("ts").over(Window.orderBy("ts"))), 1)
    opened = days.withColumn("_first", F.coalesce(gap, F.to_date("ts")))
    session_of = opened.select(F.explode(F.sequence(F.col("_first"), F.to_date("ts"))).alias("day"), "pos")
    at = events.join(F.broadcast(session_of), "day", "left")
    out = attach(at, days.agg(F.max("pos").alias("_last")))
    inside = (F.col("pos") >= 1) & (F.col("pos") + 1 + horizon <= F.col("_last"))
    for name, (back, ahead) in {"reaction": (-1, 1), "forward": (1, 1 + horizon)}.items():
        own, market = window(back, ahead, name)
        out = out.join(own, ["security_id", "pos"], "left").join(F.broadcast(market), "pos", "left")
        ok = inside & (F.abs(name) <= MAX_MOVE)
        out = out.withColumn(name, F.when(ok, F.col(name) - F.col(f"{name}_market"))).drop(f"{name}_market")
    return out.drop("_last")


def sentiment(answer) -> Column:
    """p(positive) - p(negative); NULL when either is missing."""
    p = F.from_json(answer, "struct<probabilities:map<string,double>>")["probabilities"]
    return F.try_element_at(p, F.lit("positive")) - F.try_element_at(p, F.lit("negative"))


def probe(answer) -> Column:
    return F.get_json_object(answer, "$.noul").try_cast("double") - 0.5


def _spread_rank(rows: DataFrame, value: str, other: str, name: str) -> DataFrame:
    """Mean rank of ties over all rows, which are numbered in pieces: half the sum of a value's first and last place."""
    order = [value, other]
    placed = numbered(split_ordered(rows, [], order), [], order, "_place").drop("_piece")
    rank = placed.groupBy(F.col(value).alias("_v")).agg(((F.min("_place") + F.max("_place")) / 2.0).alias(name))
    return placed.drop("_place").join(rank, F.col(value) == F.col("_v")).drop("_v")


def rank_correlation(pairs: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Rank correlation per group, three pairs at least. A group is one sample of the study; without groups all rows are
    ranked in pieces."""
    whole = pairs.dropna(subset=[x, y])
    if not by:
        ranked = _spread_rank(_spread_rank(whole.select(x, y), x, y, "_x"), y, x, "_y")
        return ranked.agg(F.when(F.count(F.lit(1)) >= 3, corr_of("_x", "_y")).alias("ic"), F.count(F.lit(1)).alias("n"))
    ranked = whole.select(*by, average_rank(x, *by).alias("_x"), average_rank(y, *by).alias("_y"))
    return ranked.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= 3, corr_of("_x", "_y")).alias("ic"), F.count(F.lit(1)).alias("n"))


def percentile_by_index(values: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """Value at place round(q * (n - 1)) of each group, half to even: groups are put in order and numbered in pieces."""
    known = values.where(F.col(value).isNotNull()).select(*by, value)
    placed = numbered(split_ordered(known, by, [value]), by, [value], "_place")
    sizes = known.groupBy(*[F.col(x).alias(f"_{x}") for x in by]).agg(F.count(F.lit(1)).alias("_n"))
    here = F.col("_place") == F.bround(F.lit(q) * (F.col("_n") - 1), 0) + 1
    for x in by:
        here = here & F.col(x).eqNullSafe(F.col(f"_{x}"))
    return placed.join(sizes, here).select(*by, F.col(value).alias("p"))


def draws(n: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(b, i, w): how often draw ``b`` with replacement of ``n`` numbered rows (one row, column ``_n``) has row ``i``, from 0.

    Each pick is a number made of MD5 digits of seed, draw and place, so that any engine draws the same.
    """
    # the places of all draws come from one row, and are dealt out before they are picked
    slots = n.select("_n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).repartition("b")
    places = slots.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / LOT)))).where("_n > 0").repartition("b", "_lot")
    first = F.col("_lot") * LOT
    places = places.select("b", "_n", F.explode(F.sequence(first, F.least(first + LOT, F.col("_n")) - 1)).alias("j"))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string")).cast("binary")), 1, 15)
    picked = places.select("b", F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.col("_n")).alias("i"))
    return picked.groupBy("b", "i").agg(F.count(F.lit(1)).alias("w"))


def weighted_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` (b, w, value...) with the mean rank of the value in its draw, where a row counts ``w`` times.

    Equal values are summed up first; running totals over the distinct ones are taken in pieces, so that no draw is
    ordered in one task.
    """
    totals = rows.groupBy("b", value).agg(F.sum("w").alias("_w"))
    upto = running_sum(split_ordered(totals, ["b"], [value]), ["b"], [value], F.col("_w"), "_upto")
    ranks = upto.select("b", value, (F.col("_upto") - F.col("_w") + (F.col("_w") + 1) / 2.0).alias(name))
    return rows.join(ranks, ["b", value])


def drawn_correlations(sample: DataFrame, key: str, xs: Sequence[str], y: str, resamples: int, seed: int) -> DataFrame:
    """(b, n, ic_<x>...): rank correlation of each of ``xs`` with ``y`` in every draw; all from the same draws."""
    whole = sample.select(key, *xs, y)
    rows = numbered(split_ordered(whole, [], [key]), [], [key], "i").select((F.col("i") - 1).alias("i"), *xs, y)
    drawn = materialised(draws(whole.agg(F.count(F.lit(1)).alias("_n")), resamples, seed).join(rows, "i").drop("i"))
    for column in (*xs, y):
        drawn = weighted_ranks(drawn, column, f"_rank_{column}")
    n = F.sum("w")
    mean = (n + 1) / 2.0
    moment = lambda a, b: F.sum(F.col("w") * F.col(f"_rank_{a}") * F.col(f"_rank_{b}")) / n - mean * mean
    ic = lambda x: F.when((n >= 3) & (moment(x, x) * moment(y, y) > 0), moment(x, y) / F.sqrt(moment(x, x) * moment(y, y)))
    return drawn.groupBy("b").agg(n.alias("n"), *[ic(x).alias(f"ic_{x}") for x in xs])


def materialised(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def interval(stats: DataFrame, value: Column, ok: Column) -> DataFrame:
    """2.5 and 97.5 % places of one value a draw."""
    g = stats.agg(F.collect_list(value).alias("v"), F.max("n").alias("n"))  # as many values as draws
    return g.select(F.when(ok, rounded_index(F.col("v"), 0.025)).alias("low"), F.when(ok, rounded_index(F.col("v"), 0.975)).alias("high"))


def bootstrap_interval(sample: DataFrame, key: str, x: str, y: str, resamples: int, seed: int) -> DataFrame:
    """95 % percentile interval of the rank correlation; NULL below 30 rows."""
    stats = drawn_correlations(sample.dropna(subset=[x, y]), key, [x], y, resamples, seed)
    return interval(stats, F.col(f"ic_{x}"), (F.col("n") >= 30) & (F.size("v") >= resamples // 2))


def gap_interval(sample: DataFrame, key: str, a: str, b: str, y: str, resamples: int, seed: int) -> DataFrame:
    """Interval of the difference of two correlations, both from the same draws."""
    stats = drawn_correlations(sample.dropna(subset=[a, b, y]), key, [a, b], y, resamples, seed)
    return interval(stats, F.col(f"ic_{a}") - F.col(f"ic_{b}"), F.col("n") >= 30)


def signal_report(sample: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Rank correlation, top minus bottom tercile and hit rate of decided signals."""
    whole = sample.dropna(subset=[x, y])
    order = [x, key]
    placed = attach(numbered(split_ordered(whole, [], order), [], order, "_r"), whole.agg(F.count(F.lit(1)).alias("_n")))
    third = F.floor(F.col("_n") / 3)
    high = F.avg(F.when(F.col("_r") > F.col("_n") - third, F.col(y)))
    low = F.avg(F.when(F.col("_r") <= third, F.col(y)))
    decided = (F.abs(x) >= DECIDED) & (F.col(y) != 0)
    right = (F.col(x) > 0) == (F.col(y) > 0)
    g = placed.agg(
        F.max("_n").alias("n"), F.when(F.floor(F.max("_n") / 3) >= 10, high - low).alias("spread"),
        ratio(F.count_if(decided & right), F.count_if(decided)).alias("hit_rate"), F.count_if(decided).alias("decided"),
    )
    return attach(g, rank_correlation(whole, x, y).select("ic"))
