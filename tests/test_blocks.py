"""Long windows from block aggregates, against the panel that repeats every bar at every moment."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_semantics import bar, bars
from tidemark.operators import blocks
from tidemark.operators.asof import rebalance_grid
from tidemark.operators.panel import bar_panel, market_panel

GRID = rebalance_grid(datetime(2020, 2, 20), datetime(2022, 6, 1), 2)


def revised(rng: random.Random, sec: str, days: int, share: float) -> list[tuple]:
    """Bars with gaps, late ones, revisions that arrive in or out of order, zero and missing adjusted prices."""
    rows = []
    for i in range(days):
        if rng.random() > share:
            continue
        ts = datetime(2019, 6, 1) + timedelta(days=i)
        price = 50 + 10 * rng.random() + i / 40
        known = ts + timedelta(days=rng.choice((1, 1, 1, 20, 90)))
        rows.append(bar(sec, ts, price, adj=rng.choice((None, 0.0, price * 0.9, price)), known=known))
        for v in range(rng.choice((0, 0, 0, 1, 2))):
            later = known + timedelta(days=rng.randint(0, 150))
            rows.append(bar(sec, ts, price + v + 1, adj=price, known=later, ingested=known + timedelta(days=rng.randint(-5, 200)), version=str(v + 2)))
    return rows


@pytest.fixture(scope="module")
def revisions(spark):
    rng = random.Random(8)
    rows = revised(rng, "A", 900, 0.9) + revised(rng, "B", 900, 0.3) + revised(rng, "C", 300, 0.8) + revised(rng, "D", 900, 0.02)
    return bars(spark, rows).cache()


@pytest.fixture(scope="module")
def benchmark(spark):
    return bars(spark, revised(random.Random(9), "M", 900, 0.95)).cache()


def by_key(df) -> dict:
    return {(r["security_id"], r["as_of"]): r["score"] for r in df.collect()}


def same(got: dict, want: dict) -> None:
    assert got.keys() == want.keys() and len(got) > 10
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v, abs=1e-9)), k


@pytest.mark.parametrize("unit", ["month", "quarter"])
@pytest.mark.parametrize(("pad", "keep"), [(200, None), (200, 60), (400, 7), (30, 1)])
def test_windows_equal_the_panel(revisions, pad, keep, unit):
    got = {(r["security_id"], r["as_of"]): (r["n"], r["oldest"], r["newest"], r["top"]) for r in blocks.long_window(revisions, GRID, pad, keep, unit=unit).collect()}
    bar_of = F.struct("ts", "px", "close")
    panel = bar_panel(revisions, GRID, pad, keep).groupBy("security_id", "as_of").agg(F.count("*").alias("n"), F.min(bar_of).alias("a"), F.max(bar_of).alias("b"), F.max(F.when(F.col("close") > 0, F.col("close"))).alias("t"))
    assert got == {(r["security_id"], r["as_of"]): (r["n"], r["a"], r["b"], r["t"]) for r in panel.collect()}


@pytest.mark.parametrize(("lookback", "least", "horizon"), [(60, 20, 3), (150, 2, 1), (5, 2, 3)])
def test_correlation_of_moves_equals_the_panel(revisions, benchmark, lookback, least, horizon):
    w = Window.partitionBy("security_id", "as_of").orderBy("ts")
    panel = market_panel(revisions, benchmark, GRID, lookback)
    for new, old in (("ls", "px"), ("lm", "mpx")):
        panel = panel.withColumn(new, F.ln(old) - F.ln(F.lag(old, horizon).over(w)))
    flat = (F.var_pop("ls") > 0) & (F.var_pop("lm") > 0)
    score = F.when((F.count("*") >= least) & (F.count("ls") >= 2) & flat, -F.try_divide(F.covar_pop("ls", "lm"), F.sqrt(F.var_pop("ls") * F.var_pop("lm"))))
    want = by_key(panel.groupBy("security_id", "as_of").agg(score.alias("score")))
    same(by_key(blocks.betting_against_correlation(revisions, benchmark, GRID, lookback, least, horizon, unit="month")), want)


def test_no_bar_is_repeated_before_a_shuffle(spark, sf_dir):
    for name in ("fpx_02_long_term_reversal", "fpx_05_betting_against_correlation", "fpx_08_fifty_two_week_high", "fpx_23_return_seasonality", "fpx_25_long_term_momentum"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(slice(" not in plan, name  # the panel's fan-out of bars to moments
        lines = plan.splitlines()
        spread = [i for i, line in enumerate(lines) if "Generate explode(sequence(" in line]
        assert spread
        for i in spread:  # what is spread over moments has been summed up by block and, where it moves, moved before
            below = next(line for line in lines[i + 1 :] if "Project" not in line)
            assert "RepartitionByExpression" in below or "Aggregate" in below or "Window" in below, below
