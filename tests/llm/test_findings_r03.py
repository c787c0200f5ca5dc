"""Findings of the third review on the operators for training data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import docstats, quality
from tidemark.llm import textbytes as tb


def test_scorer_and_threshold_come_from_all_documents(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 10)
    monkeypatch.setattr(quality, "THRESHOLD", 1.0)
    monkeypatch.setattr(quality, "KEEP_GOOD", 0.1)
    labels, scorer = quality.fit(odd)
    _, again = quality.fit(odd.repartition(5))
    assert np.array_equal(scorer.weights, again.weights) and (scorer.bias, scorer.threshold) == (again.bias, again.threshold)

    measured = [(d, o, docstats.measure(d, o)[0]) for _, _, d, o in tb.blocks(pa.array([r[1] for r in odd_rows], pa.string()))]
    p = labels.posterior(np.concatenate([quality.pattern_of(quality.votes(x)) for _, _, x in measured]))
    x = np.concatenate([quality.features(*m) for m in measured]).astype(float)
    x[:, quality.DIMENSIONS // 2 :] = 0
    for row, bins in zip(x, np.concatenate([quality.binned(m[2]) for m in measured]), strict=True):
        np.add.at(row, bins, 1)  # a slot that two statistics share counts twice, as in the scores
    s = 1 / (1 + np.exp(-(x @ scorer.weights + scorer.bias)))
    gap = (p / (2 * p.sum()) + (1 - p) / (2 * (1 - p).sum())) * (s - p)
    assert np.linalg.norm([*(gap @ x + 1e-4 * scorer.weights), gap.sum() + 1e-4 * scorer.bias]) < 2e-5

    found = odd.select(quality.score(spark, scorer, F.col("text")).alias("a")).select("a.*").toPandas()
    good = np.sort(found["score"][labels.posterior(found["pattern"].to_numpy()) >= 0.9])
    assert scorer.threshold <= good[int(0.1 * len(good))] < scorer.threshold + 2**-20


def test_counts_of_trigrams_in_long_and_many_texts():
    texts = ["a" * 70_000, None, "ab " * 200, *["x"] * 600, "zw" * tb.SEGMENT]
    for _, _, data, offsets in tb.blocks(pa.array(texts, pa.string())):
        slots = quality.trigram_slots(data, offsets[:-1])
        want = [np.bincount(slots[a:b], minlength=quality.DIMENSIONS // 2) for a, b in zip(offsets, offsets[1:], strict=False)]
        assert np.array_equal(np.concatenate(list(quality.trigram_counts(data, offsets))), want)
