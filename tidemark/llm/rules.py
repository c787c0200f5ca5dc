"""Quality rules by an isolation forest on rule statistics.

Each tree isolates rows of a small sample by random splits of random statistics; documents that few splits isolate are
anomalous, and the mean path length over the trees, set against that of a random search tree, is the score. Above a
threshold a document is dropped. The threshold is set on labelled rows: among the scores' bins, the one that best
parts good from bad documents while losing at most LOSS of the good ones.

The statistics of all documents are written once, as narrow rows; sample, scores and calibration read those. Odd input:
a null text has no words and fails the base rule; without labelled rows of both kinds the threshold is DEFAULT; equal
rows get equal scores; the empty table gives no rows; labels that repeat a document count as often as they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import docstats
from tidemark.llm import textbytes as tb
from tidemark.llm.shared import HASH_UNITS, hash_unit, materialise

TREES = 128
SAMPLE = 256  #: rows that a tree isolates
DEPTH = 10
BINS = 2000
LOSS = 0.005  #: share of good labelled documents that the threshold may drop
DEFAULT = 0.7
SEED = 7
MIN_WORDS = 10
KINDS = ", ".join(f"{name}: bigint" for name in docstats.NAMES)


def measured(texts: pa.Array) -> pa.StructArray:
    parts = [docstats.measure(data, offsets)[0] for _, _, data, offsets in tb.blocks(texts)]
    x = np.concatenate(parts) if parts else np.empty((0, len(docstats.NAMES)), np.int64)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1])], list(docstats.NAMES))


def statistics(text: str | Column) -> Column:
    """Column of the statistics of docstats.NAMES."""

    @F.arrow_udf(f"struct<{KINDS}>")
    def answer(texts: pa.Array) -> pa.Array:
        return measured(texts)

    return answer(text)


RATIOS = {
    "symbols": ("n_symbols", "n_words"), "capitals": ("n_upper", "n_letters"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "shouts": ("n_shouts", "n_words"), "stops": ("n_stops", "n_words"), "pipes": ("n_pipes", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
FEATURES = (*RATIOS, "variety")
PRIOR = {"n_words": 40.0, "n_letters": 200.0, "n_lines": 5.0, "word_chars": 200.0}  #: short texts are drawn to the corpus's ratio by as much


def totals(stats: DataFrame) -> dict[str, float]:
    """Sums of the statistics over all documents."""
    row = stats.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in docstats.NAMES]).first()
    return {c: row[c] or 0.0 for c in docstats.NAMES}


def rule_values(total: dict[str, float]) -> list[Column]:
    """The rule statistics from the columns of docstats.NAMES: ratios, and the growth of the vocabulary with the text."""
    out = []
    for a, b in RATIOS.values():
        k = PRIOR[b]
        out.append(F.log1p(20 * (F.col(a) + k * total[a] / max(total[b], 1.0)) / (F.col(b) + k)))
    k = PRIOR["n_words"]
    out.append(F.log(F.col("n_distinct_words") + k) / F.log(F.col("n_words") + k))
    return [c.cast("double") for c in out]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def usual_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete trees as arrays over heap places: statistic, cut, and the path length of a leaf (else nan)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    scale: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 for rows isolated early, about one half for usual ones."""
        total = np.zeros(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = np.isnan(leaf[at])
                if not inner.any():
                    break
                side = x[np.arange(len(x)), feature[at]] >= cut[at]
                at = np.where(inner, 2 * at + 1 + side, at)
            total += leaf[at]
        return np.exp2(-total / len(self.leaf) / self.scale)


def grow(sample: np.ndarray, trees: int = TREES, seed: int = SEED) -> Forest:
    """Trees over random parts of the sample; splits are uniform between the extremes of a statistic that varies."""
    rng = np.random.default_rng(seed)
    size = (1 << DEPTH + 1) - 1
    feature, cut, leaf = np.zeros((trees, size), np.int64), np.zeros((trees, size)), np.full((trees, size), np.nan)
    for t in range(trees):
        rows = sample[rng.permutation(len(sample))[:SAMPLE]]
        open_ = [(0, 0, rows)]
        while open_:
            at, depth, part = open_.pop()
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(sample.shape[1]),) * 2
            varies = np.flatnonzero(high > low)
            if depth == DEPTH or len(part) <= 1 or not len(varies):
                leaf[t, at] = depth + float(usual_path(len(part)))
                continue
            f = rng.choice(varies)
            c = rng.uniform(low[f], high[f])
            feature[t, at], cut[t, at] = f, c
            side = part[:, f] >= c
            open_ += [(2 * at + 1, depth + 1, part[~side]), (2 * at + 2, depth + 1, part[side])]
    return Forest(feature, cut, leaf, max(float(usual_path(min(SAMPLE, len(sample)))), 1.0))


def score(spark, forest: Forest, values: Column) -> Column:
    sent = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def answer(lists: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))))

    return answer(values)


def calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """Threshold from the labelled rows' scores by bin: (key, anomaly) joined with (doc_id, quality)."""
    known = labels.select(F.col("doc_id").alias("key"), "quality").where(F.col("quality").isNotNull())
    bins = scored.where(~F.col("base_failed")).join(known, "key").groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")).agg(F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)), F.sum(F.when(F.col("quality") > 0, 0).otherwise(1))).collect()
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for b, g, w in bins:
        good[b], bad[b] = g, w
    if not good.sum() or not bad.sum():
        return DEFAULT
    lost, caught = good[::-1].cumsum()[::-1] / good.sum(), bad[::-1].cumsum()[::-1] / bad.sum()  # at or above each bin
    gain = np.where(lost <= LOSS, caught - lost, -1.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[-1]) / BINS  # of equal ones, the highest


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, the statistics, base_failed, anomaly, threshold, kept) of each row."""
    spark = docs.sparkSession
    stats = docs.select(F.col(key).alias("key"), statistics(F.col(text)).alias("s")).select("key", "s.*")
    stats = materialise(stats, "rules")
    stats = stats.withColumn("base_failed", base_failed()).withColumn("x", F.array(*rule_values(totals(stats))))
    n = stats.count()
    wanted = 16 * SAMPLE
    drawn = stats.where(hash_unit("key", "x") < int(min(1.0, wanted / max(n, 1)) * HASH_UNITS)).select(hash_unit("key", "x").alias("at"), "x").orderBy("at", "x").limit(2 * wanted)
    sample = np.array([r["x"] for r in drawn.collect()], float).reshape(-1, len(FEATURES))
    scored = stats.withColumn("anomaly", score(spark, grow(sample), F.col("x")))
    threshold = calibrate(scored.select("key", "anomaly", "base_failed"), labels)
    keep = ~F.col("base_failed") & (F.col("anomaly") < threshold)
    return scored.select("key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", keep.alias("kept"), "anomaly", F.lit(threshold).alias("threshold"))
