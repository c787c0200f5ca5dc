"""Bootstrap draws, weighted ranks and exact percentiles, against lists in memory."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import news


def ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def correlation(x, y):
    n = len(x)
    mx, my = sum(x) / n, sum(y) / n
    xx, yy = sum((a - mx) ** 2 for a in x), sum((b - my) ** 2 for b in y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / (xx * yy) ** 0.5 if xx * yy else None


@pytest.mark.parametrize("lot", [1 << 16, 7])
def test_draws_and_their_correlations(spark, monkeypatch, lot):
    monkeypatch.setattr(news, "LOT", lot)
    rng = random.Random(1)
    rows = [(i * 3, rng.choice((0.0, 0.0, 1.5, rng.random())), rng.random(), rng.choice((1.0, rng.random()))) for i in range(40)]
    sample = spark.createDataFrame(rows, "id long, x double, z double, y double").repartition(3)
    got = {r["b"]: r for r in news.drawn_correlations(sample, "id", ["x", "z"], "y", 12, 4).collect()}
    assert sorted(got) == list(range(12))
    for b, r in got.items():
        picks = [rows[int(hashlib.md5(f"4:{b}:{j}".encode()).hexdigest()[:15], 16) % 40] for j in range(40)]
        y = ranks([p[3] for p in picks])
        assert r["n"] == 40
        assert r["ic_x"] == pytest.approx(correlation(ranks([p[1] for p in picks]), y))
        assert r["ic_z"] == pytest.approx(correlation(ranks([p[2] for p in picks]), y))


def test_intervals_of_too_few_rows_are_null(spark):
    rows = [(i, float(i), float(i % 5), 1.0) for i in range(29)]
    sample = spark.createDataFrame(rows, "id long, x double, y double, flat double")
    assert tuple(news.bootstrap_interval(sample, "id", "x", "y", 10, 1).first()) == (None, None)
    assert tuple(news.bootstrap_interval(sample.limit(0), "id", "x", "y", 10, 1).first()) == (None, None)
    many = sample.unionByName(sample.withColumn("id", F.col("id") + 100))
    assert tuple(news.bootstrap_interval(many, "id", "x", "flat", 10, 1).first()) == (None, None)  # no variance, no correlation
    low, high = news.bootstrap_interval(many, "id", "x", "y", 20, 1).first()
    assert -1 <= low <= high <= 1


def test_percentiles_without_lists(spark):
    rng = random.Random(2)
    groups = {"a": [rng.random() for _ in range(101)], "b": [1.0] * 7 + [2.0], "c": [5.0], None: [3.0, 1.0, 2.0]}
    table = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None)], "g string, v double").repartition(4)
    for q in (0.0, 0.025, 0.3, 0.5, 1.0):
        found = news.percentile_by_index(table, "v", q, "g")
        assert {r["g"]: r["p"] for r in found.collect()} == {g: sorted(vs)[round(q * (len(vs) - 1))] for g, vs in groups.items()}
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
