"""Exact trees and forests against a search over lists in memory."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees

NAMES = ["a", "b", "c"]


def table(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, a double, b double, c double, target double").repartition(5)


def brute(rows, offered, depth, least, node=1):
    """{node: (feature, threshold, value, samples)} by trying every cut of whole lists."""
    units = [round(r[3] * 1e9) for r in rows]
    here = (None, None, sum(units) / len(units) / 1e9, len(rows))
    best = None
    if depth:
        for k, name in enumerate(offered):
            at = NAMES.index(name)
            values = sorted({r[at] for r in rows})
            for low, high in zip(values, values[1:]):
                cut = (low + high) / 2
                left = [u for u, r in zip(units, rows) if r[at] <= cut]
                right = [u for u, r in zip(units, rows) if r[at] > cut]
                if min(len(left), len(right)) < least:
                    continue
                gap = sum(left) / len(left) - sum(right) / len(right)
                gain = len(left) * len(right) / len(rows) * gap * gap
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, name, cut, at)
    if best is None:
        return {node: here}
    _, name, cut, at = best
    out = {node: (name, cut, *here[2:])}
    out |= brute([r for r in rows if r[at] <= cut], offered, depth - 1, least, 2 * node)
    return out | brute([r for r in rows if r[at] > cut], offered, depth - 1, least, 2 * node + 1)


def model_of(found, tree=0):
    return {r["node"]: (r["feature"], r["threshold"], r["value"], r["samples"]) for r in found.collect() if r["tree"] == tree}


def same(got, expected):
    assert sorted(got) == sorted(expected)
    for node, (feature, cut, value, samples) in expected.items():
        assert got[node][:2] == (feature, cut)
        assert got[node][2] == pytest.approx(value, abs=1e-12)
        assert got[node][3] == samples


def answer(model, row, node=1):
    feature, cut, value, _ = model[node]
    return value if feature is None else answer(model, row, 2 * node + (row[NAMES.index(feature)] > cut))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_tree_is_the_exhaustive_search(spark, depth):
    rng = random.Random(depth)
    # few distinct values, one of them a third of the rows, and a copy of a column: many equal gains
    rows = [(x := rng.choice((0.0, 0.0, 1.0, 2.5, rng.random())), x, rng.randrange(4), round(rng.gauss(x * x, 0.5), 3)) for _ in range(90)]
    found = trees.fit_tree(table(spark, rows), NAMES, depth=depth)
    expected = brute(rows, NAMES, depth, 9)
    same(model_of(found), expected)
    assert not any(f == "b" for f, *_ in expected.values())  # of equal columns the first is taken
    told = {r["id"]: r["prediction"] for r in trees.predict(table(spark, rows), found).collect()}
    assert told == {i: pytest.approx(answer(expected, r)) for i, r in enumerate(rows)}


def test_forest_is_the_search_over_drawn_lists(spark):
    rng = random.Random(9)
    rows = [(rng.random(), rng.choice((1.0, 2.0)), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(40)]
    rows += rows[:5]
    n = len(rows)
    found = trees.fit_forest(table(spark, rows), NAMES, ["id"], trees=6, size=2, seed=3)
    told = {r["id"]: r["prediction"] for r in trees.predict(table(spark, rows), found).collect()}
    models = []
    for t in range(6):
        bag = [rows[int(hashlib.md5(f"3:{t}:{j}".encode()).hexdigest()[:15], 16) % n] for j in range(n)]
        offered = sorted(NAMES, key=lambda x: hashlib.md5(f"3:{t}:{x}".encode()).hexdigest())[:2]
        models.append(brute(bag, offered, 2, 4))
        same(model_of(found, t), models[t])
    assert told == {i: pytest.approx(sum(answer(m, r) for m in models) / 6) for i, r in enumerate(rows)}


def test_odd_samples(spark):
    flat = table(spark, [(i, i % 3, 1, 0.1) for i in range(30)])
    assert model_of(trees.fit_tree(flat, NAMES)) == {1: (None, None, 0.1, 30)}  # no cut helps
    few = table(spark, [(0, 0, 0, 1), (1, 1, 1, 3)])
    assert model_of(trees.fit_tree(few, NAMES)) == {1: (None, None, 2.0, 2)}  # both sides need three samples
    with pytest.raises(ValueError, match="no samples"):
        trees.fit_tree(flat.limit(0), NAMES)
    with pytest.raises(ValueError, match="30 samples"):
        trees.fit_tree(flat.withColumn("c", F.lit(math.nan)), NAMES)
    with pytest.raises(ValueError, match="30 samples"):
        trees.fit_forest(flat.withColumn("target", F.lit(None).cast("double")), NAMES, ["id"])
    step = table(spark, [(i, 0, 0, float(i >= 10)) for i in range(20)])
    model = trees.fit_tree(step, NAMES)
    assert model_of(model)[1][:2] == ("a", 9.5)
    asked = spark.createDataFrame([(9.5,), (9.6,), (None,)], "a double")
    assert [r["prediction"] for r in trees.predict(asked, model).collect()] == [0.0, 1.0, None]
