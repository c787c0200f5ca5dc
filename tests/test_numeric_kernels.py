"""Least squares and the normal distribution in column expressions, against numpy and the standard library."""

from __future__ import annotations

import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.normal import normal_cdf, normal_quantile
from tidemark.functions.regression import coefficients, gram_sums, r_squared


def test_normal_distribution_and_its_inverse(spark):
    zs = [0.0, 1e-9, -1e-9, 7.0, 7.2, -7.2, 9.5, -9.5, -37.0] + [random.Random(1).uniform(-8, 8) for _ in range(300)]
    n = NormalDist()
    found = spark.createDataFrame([(z,) for z in zs] + [(None,)], "z double").select("z", normal_cdf("z").alias("p")).collect()
    assert all(r["p"] is None if r["z"] is None else r["p"] == pytest.approx(n.cdf(r["z"]), rel=1e-7, abs=1e-15) for r in found)
    ps = [n.cdf(z) for z in zs if abs(z) < 6] + [1e-12, 1 - 1e-12, 0.02425, 0.97575]
    found = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile("p").alias("z")).collect()
    assert all(r["z"] == pytest.approx(n.inv_cdf(r["p"]), abs=2e-9 if 1e-9 < r["p"] < 1 - 1e-9 else 1e-4) for r in found)
    assert [r["z"] for r in spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (None,)], "p double").select(normal_quantile("p").alias("z")).collect()] == [None] * 4


@pytest.mark.parametrize(("unknown", "ridge"), [(1, 0.0), (2, 0.5), (6, 0.0), (6, 1e-6), (12, 0.1)])
def test_coefficients_equal_numpy(spark, unknown, ridge):
    rng = np.random.default_rng(unknown)
    x = rng.normal(size=(80, unknown)) * 10.0 ** rng.integers(-3, 3, unknown)
    y = 3 + x @ rng.normal(size=unknown) + rng.normal(size=80)
    table = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], ", ".join(f"x{i} double" for i in range(unknown)) + ", y double")
    names = [f"x{i}" for i in range(unknown)]
    row = table.agg(gram_sums("y", names).alias("g")).select(coefficients("g", ridge).alias("b"), r_squared("g").alias("r2")).first()
    a = np.column_stack([np.ones(80), x])
    assert row["b"] == pytest.approx(np.linalg.solve(a.T @ a + ridge * np.eye(unknown + 1), a.T @ y), rel=1e-6)
    fitted = a @ np.linalg.lstsq(a, y, rcond=None)[0]
    assert row["r2"] == pytest.approx(1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_systems_without_an_answer_are_null(spark):
    table = spark.createDataFrame([(float(i), float(2 * i), 1.0, float(i * i)) for i in range(9)], "x double, twice double, flat double, y double")
    for xs in (["x", "twice"], ["flat"], ["x", "twice", "flat"]):
        row = table.agg(gram_sums("y", xs).alias("g")).select(coefficients("g").alias("b"), r_squared("g").alias("r2")).first()
        assert tuple(row) == (None, None)
    few = table.limit(1).agg(gram_sums("y", ["x"]).alias("g"))
    none = table.limit(0).agg(gram_sums("y", ["x"]).alias("g"))
    assert [tuple(g.select(coefficients("g").alias("b"), r_squared("g").alias("r2")).first()) for g in (few, none)] == [(None, None)] * 2
    assert table.agg(gram_sums("flat", ["x"]).alias("g")).select(r_squared("g").alias("r2")).first()["r2"] is None
    plan = few.select(r_squared("g"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
