"""Small fixtures with values worked out by hand, one per rule that is easy to get wrong."""

from __future__ import annotations

import itertools
import math
import random
import statistics
from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numeric as nm
from tidemark.functions import scalars as sc
from tidemark.functions.regression import coefficients, gram_sums, r_squared
from tidemark.operators import performance as pf
from tidemark.operators import reads as rd
from tidemark.operators import scans
from tidemark.operators import signals as sg
from tidemark.operators.asof import asof_join, bars_on_grid, calendar_join, facts_on_grid, next_join, rebalance_grid
from tidemark.operators.price_factors import FACTORS, score_factors

D = datetime
BAR = (
    "security_id string, ts timestamp, open double, high double, low double, close double, volume double, adjusted_close double, "
    "adjusted_high double, adjusted_low double, available_time timestamp, ingestion_time timestamp, data_version string, source string"
)


def bar(sec, ts, close, adj=None, known=None, ingested=None, version="1", volume=100.0):
    known = known or ts + timedelta(hours=20)
    return (sec, ts, close, close + 1, close - 1, close, volume, adj, close + 1, close - 1, known, ingested or known, version, "t")


def bars(spark, rows):
    return spark.createDataFrame(rows, BAR)


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    got = dict(values(df.groupBy("k").agg(nm.corr_of("x", "y").alias("r")), "k", "r"))
    assert got["a"] is None and got["c"] is None and got["b"] == pytest.approx(1.0)


def test_division_by_zero_is_null(spark):
    assert spark.range(1).select(nm.ratio(F.lit(1.0), F.lit(0.0)).alias("x")).first().x is None


def test_zero_adjusted_price_falls_back_only_where_asked(spark):
    df = spark.createDataFrame([(0.0, 5.0), (None, 5.0), (4.0, 5.0)], "a double, c double")
    got = df.select(nm.fallback_zero("a", "c").alias("z"), nm.fallback_null("a", "c").alias("n")).collect()
    assert [(r.z, r.n) for r in got] == [(5.0, 0.0), (5.0, 5.0), (4.0, 4.0)]


def test_rebalance_chain_clamps_step_by_step():
    assert [g.day for g in rebalance_grid(D(2023, 1, 31), D(2023, 5, 1), 1)] == [31, 28, 28, 28]


def test_chained_months_column_matches_grid(spark):
    got = spark.createDataFrame([(D(2023, 1, 31), D(2024, 3, 1))], "a timestamp, b timestamp").select(sc.chained_months("a", "b", 1).alias("x")).first().x
    assert got == rebalance_grid(D(2023, 1, 31), D(2024, 3, 1), 1)


def test_bar_of_the_day_is_hidden_at_midnight_and_revisions_wait(spark):
    day = D(2024, 3, 1)
    rows = [bar("A", day, 10.0), bar("A", day, 11.0, known=D(2024, 3, 5), version="2"), bar("A", D(2024, 3, 2), 12.0)]
    got = bars_on_grid(bars(spark, rows), [D(2024, 3, 1), D(2024, 3, 3), D(2024, 3, 6)], 30)
    assert values(got, "as_of", "ts", "close") == [
        (D(2024, 3, 3), day, 10.0), (D(2024, 3, 3), D(2024, 3, 2), 12.0), (D(2024, 3, 6), day, 11.0), (D(2024, 3, 6), D(2024, 3, 2), 12.0),
    ]


def test_critical_flag_hides_the_bar(spark):
    rows = [bar("A", D(2024, 3, 1), 10.0), bar("A", D(2024, 3, 2), 12.0)]
    flags = spark.createDataFrame([("A", D(2024, 3, 2), "x", "CRITICAL"), ("A", D(2024, 3, 1), "x", "WARNING")], "security_id string, ts timestamp, check_name string, severity string")
    got = bars_on_grid(bars(spark, rows), [D(2024, 3, 5)], 30, flags)
    assert values(got, "close") == [(10.0,)]


def test_vintage_is_picked_before_null_and_withdrawn_are_dropped(spark):
    rows = [
        ("S", D(2024, 1, 1), 1.0, D(2024, 2, 1), None, D(2024, 2, 2)),
        ("S", D(2024, 1, 1), None, D(2024, 3, 1), None, D(2024, 3, 2)),
        ("T", D(2024, 1, 1), 2.0, D(2024, 2, 1), D(2024, 2, 20), D(2024, 2, 2)),
    ]
    v = spark.createDataFrame(rows, "series_id string, observation_date timestamp, value double, realtime_start timestamp, realtime_end timestamp, available_time timestamp")
    got = rd.series_on_grid(v, [D(2024, 2, 10), D(2024, 3, 10)])
    assert values(got, "series_id", "as_of") == [("S", D(2024, 2, 10)), ("T", D(2024, 2, 10))]


def test_nan_is_a_finding_not_a_large_value(spark):
    from tidemark.operators import quality as dq

    rows = [bar("A", D(2024, 3, 1), 10.0), ("A", D(2024, 3, 2), 1.0, math.nan, 0.5, 1.0, 1.0, None, None, None, D(2024, 3, 2), D(2024, 3, 2), "1", "t")]
    assert dq.non_finite(bars(spark, rows)).count() == 1
    assert dq.ohlc(bars(spark, rows)).count() == 1


def test_percentile_flavours(spark):
    a = spark.createDataFrame([([5.0, 1.0, 4.0, 2.0, 3.0],)], "v array<double>")
    r = a.select(nm.nearest_rank(F.col("v"), 0.8).alias("n"), nm.rounded_index(F.col("v"), 0.375).alias("i")).first()
    assert (r.n, r.i) == (4.0, 3.0)


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 5.0)], "k string, v double").withColumn("p", F.lit(1))
    assert values(df.select("k", nm.average_rank("v", "p").alias("r")), "k", "r") == [("a", 1.0), ("b", 2.5), ("c", 2.5), ("d", 4.0)]


@pytest.mark.parametrize("year,day", [(1999, (4, 4)), (2000, (4, 23)), (2001, (4, 15)), (2008, (3, 23)), (2024, (3, 31)), (2038, (4, 25)), (2049, (4, 18))])
def test_easter(spark, year, day):
    got = spark.createDataFrame([(year,)], "y int").select(sc.easter("y").alias("e")).first().e
    assert (got.month, got.day) == day


def test_exchange_holidays_2024(spark):
    got = spark.createDataFrame([(2024,)], "y int").select(sc.exchange_holidays("y").alias("h")).first().h
    assert [(h.month, h.day) for h in got] == [(1, 1), (1, 15), (2, 19), (3, 29), (5, 27), (6, 19), (7, 4), (9, 2), (11, 28), (12, 25)]


def test_names_and_cusips(spark):
    df = spark.createDataFrame([("The Procter & Gamble Co.", "037833100"), ("QUALCOMM INC/DE", "594918104"), ("Coca Cola Company", "037833101")], "t string, c string")
    got = df.select(sc.core_name("t").alias("n"), sc.cusip_check_ok("c").alias("ok")).collect()
    assert [(r.n, r.ok) for r in got] == [("PROCTER GAMBLE", True), ("QUALCOMM", True), ("COCA COLA", False)]


def test_masking_covers_the_whole_text(spark):
    text = "Acme's shares (NYSE: ACM) rose; $ACM, ACM and Acme Corp. " + "x " * 500 + "ACM"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(sc.mask_text("t", F.array(F.lit("Acme"), F.lit("Acme Corp")), F.lit("ACM")).alias("m")).first().m
    assert "Acme" not in got and "ACM" not in got and got.startswith("the company shares (the company's ticker)")


def test_drawdown_episodes(spark):
    path = [100.0, 90.0, 80.0, 100.0, 120.0, 110.0]
    df = spark.createDataFrame([("g", D(2024, 1, 1 + i), v) for i, v in enumerate(path)], "grp string, ts timestamp, value double")
    got = values(pf.drawdown_episodes(df).fillna(-1.0), "peak_time", "trough_time", "recovery_time", "depth")
    assert got[0] == (D(2024, 1, 1), D(2024, 1, 3), D(2024, 1, 4), pytest.approx(-0.2))
    assert got[1][:3] == (D(2024, 1, 5), D(2024, 1, 6), None)


def test_pbo_matches_brute_force(spark):
    rng = random.Random(3)
    folds = {f"c{k}": [round(rng.gauss(0, 1), 6) for _ in range(18)] for k in range(5)}
    rows = [(n, i, v) for n, vs in folds.items() for i, v in enumerate(vs)]
    got = sg.cscv_logits(spark.createDataFrame(rows, "candidate string, fold int, net_return double")).collect()
    size = 18 // 8
    group = [min(i // size, 7) for i in range(18)]
    names, logits = sorted(folds), []
    for chosen in itertools.combinations(range(8), 4):
        ins = {n: statistics.mean(v for v, g in zip(folds[n], group) if g in chosen) for n in names}
        oos = {n: statistics.mean(v for v, g in zip(folds[n], group) if g not in chosen) for n in names}
        best = max(names, key=lambda n: ins[n])
        omega = (sorted(names, key=lambda n: oos[n]).index(best) + 1) / 6
        logits.append(math.log(omega / (1 - omega)))
    assert sorted(r.logit for r in got) == pytest.approx(sorted(logits))


def test_deflated_sharpe_by_hand(spark):
    rng = random.Random(5)
    folds = {f"c{k}": [rng.gauss(0.1 * k, 1) for _ in range(12)] for k in range(4)}
    df = spark.createDataFrame([(n, i, v) for n, vs in folds.items() for i, v in enumerate(vs)], "candidate string, fold int, net_return double")
    got = {r.candidate: r.dsr for r in sg.deflated_sharpe(df, zero_trials=2).collect()}
    sharpes = {n: statistics.mean(v) / statistics.pstdev(v) for n, v in folds.items()}
    n_trials = 6
    var = statistics.pvariance([*sharpes.values(), 0.0, 0.0])
    nd = statistics.NormalDist()
    g = 0.5772156649015329
    sr0 = math.sqrt(var) * ((1 - g) * nd.inv_cdf(1 - 1 / n_trials) + g * nd.inv_cdf(1 - 1 / (n_trials * math.e)))
    for n, v in folds.items():
        m, s = statistics.mean(v), statistics.pstdev(v)
        skew = sum((x - m) ** 3 for x in v) / 12 / s**3
        kurt = sum((x - m) ** 4 for x in v) / 12 / s**4
        z = (sharpes[n] - sr0) * math.sqrt(11) / math.sqrt(1 - skew * sharpes[n] + (kurt - 1) / 4 * sharpes[n] ** 2)
        assert got[n] == pytest.approx(nd.cdf(z))


def test_reality_checks_see_a_dominant_candidate(spark):
    rng = random.Random(1)
    rows = [(f"c{k}", i, rng.gauss(0, 0.01) + (0.05 if k == 2 else 0.0)) for k in range(4) for i in range(24)]
    df = spark.createDataFrame(rows, "candidate string, fold int, net_return double")
    for fn in (sg.reality_check, sg.superior_ability):
        r = fn(df, samples=200).first()
        assert r.best == "c2" and r.p_value < 0.02


def test_bootstrap_paths_are_runs_of_the_fold_circle(spark):
    df = spark.createDataFrame([("c", i, 0.0) for i in range(20)], "candidate string, fold int, net_return double")
    got = sg.bootstrap_paths(df, 50, 4.0, 9).orderBy("sample", "place").collect()
    assert len(got) == 1000 and all(0 <= r.pos < 20 for r in got)
    follows = sum(b.pos == (a.pos + 1) % 20 for a, b in zip(got, got[1:]) if a.sample == b.sample)
    assert 0.65 < follows / 950 < 0.85


def test_regression_from_sums(spark):
    rng = random.Random(2)
    pts = [(x := rng.random(), w := rng.random(), 1 + 2 * x - 3 * w) for _ in range(40)]
    df = spark.createDataFrame([tuple(p) for p in pts], "x double, w double, y double")
    r = df.agg(gram_sums("y", ["x", "w"]).alias("g")).select(coefficients("g", 0.0).alias("b"), r_squared("g").alias("r2")).first()
    assert r.b == pytest.approx([1.0, 2.0, -3.0]) and r.r2 == pytest.approx(1.0)
    assert df.agg(gram_sums("y", ["x", "x"]).alias("g")).select(r_squared("g").alias("r2")).first().r2 is None


def _random_rows(seed, n=400):
    rng = random.Random(seed)
    t0 = D(2024, 1, 1)
    # one key holds most rows
    key = lambda: "hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}"
    left = [(i, key(), t0 + timedelta(hours=rng.randrange(2400))) for i in range(n)]
    right = sorted({(key(), t0 + timedelta(hours=rng.randrange(2400))) for _ in range(n)})
    return left, [(k, t, j) for j, (k, t) in enumerate(right)]


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_matches_brute_force_with_a_hot_key(spark, strict):
    left, right = _random_rows(4)
    lf, rf = spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, u timestamp, v int")
    got = {r.id: r.v for r in asof_join(lf, rf, ["k"], "t", "u", strict=strict, chunk="day").collect()}
    for i, k, t in left:
        seen = [(u, v) for kk, u, v in right if kk == k and (u < t or (u == t and not strict))]
        assert got[i] == (max(seen)[1] if seen else None)
    if not strict:
        nxt = {r.id: r.v for r in next_join(lf, rf, ["k"], "t", "u").collect()}
        for i, k, t in left:
            later = [(u, v) for kk, u, v in right if kk == k and u >= t]
            assert nxt[i] == (min(later)[1] if later else None)


@pytest.mark.parametrize("strict", [False, True])
def test_calendar_join_matches_brute_force(spark, strict):
    left, right = _random_rows(8)
    days = sorted({u for _, u, _ in right if u.day % 9})
    lf, rf = spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame([(u,) for u in days], "u timestamp")
    got = {r.id: r.u for r in calendar_join(lf, rf, "t", "u", strict=strict).collect()}
    for i, _, t in left:
        seen = [u for u in days if u < t or (u == t and not strict)]
        assert got[i] == (max(seen) if seen else None)


def test_three_asof_shapes_agree(spark):
    """Grid carry-forward, per-row join and a plain maximum give the same latest fact."""
    _, right = _random_rows(6)
    facts = spark.createDataFrame(right, "k string, u timestamp, v int")
    grid = [D(2024, 1, 1) + timedelta(days=9 * i) for i in range(12)]
    a = values(facts_on_grid(facts, grid, ["k"], ["u"], known="u"), "k", "as_of", "v")
    keys = sorted({k for k, _, _ in right})
    probes = spark.createDataFrame([(k, g) for k in keys for g in grid], "k string, as_of timestamp")
    b = values(asof_join(probes, facts, ["k"], "as_of", "u").filter("v is not null"), "k", "as_of", "v")
    c = sorted((k, g, max((u, v) for kk, u, v in right if kk == k and u <= g)[1]) for k in keys for g in grid if any(kk == k and u <= g for kk, u, _ in right))
    assert a == b == c


def test_scans_match_plain_windows_on_a_hot_group(spark):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.8 else f"g{rng.randrange(3)}", i, rng.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    pieces = scans.split_ordered(df, ["g"], ["o"])
    want = {}
    for g in {r[0] for r in rows}:
        total, top, last = 0, None, None
        for n, (_, o, v) in enumerate(sorted(r for r in rows if r[0] == g), 1):
            total += v
            want[o] = (n, total, top, last)
            top, last = (v if top is None else max(top, v)), v
    one = scans.numbered(pieces, ["g"], ["o"], "n")
    two = scans.running_sum(one, ["g"], ["o"], F.col("v"), "s")
    three = scans.earlier_max(two, ["g"], ["o"], F.col("v"), "m")
    four = scans.previous(three, ["g"], ["o"], F.col("v"), "p")
    assert {r.o: (r.n, r.s, r.m, r.p) for r in four.collect()} == want


def test_streak_summaries_join_across_a_seam(spark):
    rng = random.Random(13)
    rows = [("a" if rng.random() < 0.8 else "b", i, float(rng.choice([-1, 1, 1]))) for i in range(120)]
    df = spark.createDataFrame(rows, "grp string, o int, realized_pnl double")
    whole = values(pf.streaks(df, ["grp"], ["o"]), "grp", "max_wins", "max_losses")
    parts = [pf.streak_summary(df.filter((F.col("o") >= a) & (F.col("o") < b)), ["grp"], ["o"]) for a, b in ((0, 30), (30, 31), (31, 120))]
    joined = pf.chain_streaks(reduce(DataFrame.unionByName, [p.withColumn("nth", F.lit(i)) for i, p in enumerate(parts)]), ["grp"], "nth")
    assert values(joined, "grp", "max_wins", "max_losses") == whole


def test_no_factor_looks_ahead(spark):
    """Rows that become known after the moment must not change any price factor."""
    rng = random.Random(17)
    rows, t = [], D(2022, 1, 3)
    for i in range(420):
        day = t + timedelta(days=i)
        if day.weekday() < 5:
            rows.append(bar("A", day, 100 + 10 * rng.random(), version="1", volume=50 + 100 * rng.random()))
    as_of = D(2023, 2, 1)
    names = sorted(FACTORS)
    before = score_factors(bars(spark, rows), [as_of], names).first()
    late = [bar("A", as_of, 500.0), bar("A", as_of + timedelta(days=1), 900.0)]
    late += [bar("A", r[1], 700.0, known=as_of + timedelta(days=2), version="9") for r in rows[::7] if r[1] < as_of]
    assert score_factors(bars(spark, rows + late), [as_of], names).first() == before


def test_no_cut_in_windows_and_months(spark):
    df = spark.createDataFrame([("g", D(1900, 1, 31), D(2020, 1, 1))], "grp string, start timestamp, end timestamp")
    assert pf.walk_forward(df, 24, 6, 1).count() == 120 * 12 - 30
    assert len(df.select(sc.chained_months("start", "end", 1).alias("x")).first().x) == 1440


def test_deep_lineage_and_cycle(spark):
    from tidemark.operators.journal import lineage_depth

    chain = [(i, i - 1 if i else None) for i in range(300)]
    got = {r.model: r.generation for r in lineage_depth(spark.createDataFrame(chain, "model int, parent int")).collect()}
    assert got == {i: i for i in range(300)}
    with pytest.raises(ValueError):
        lineage_depth(spark.createDataFrame([*chain[:5], (900, 901), (901, 900)], "model int, parent int"))


def test_open_membership_lasts_to_the_newest_bar(spark):
    from tidemark.operators.reads import members_with_prices

    intervals = spark.createDataFrame([("A", D(2000, 1, 1), None)], "ticker string, start_date timestamp, end_date timestamp")
    bars = spark.createDataFrame([("A", D(2010, 5, 1))], "security_id string, ts timestamp")
    assert sorted(r.year for r in members_with_prices(intervals, bars).collect()) == list(range(2000, 2011))


def test_levels_after_a_zero_step(spark):
    bars = spark.createDataFrame([bar("A", D(2024, 1, i + 1), c) for i, c in enumerate([10.0, 0.0, 10.0, 20.0])], BAR)
    none = spark.createDataFrame([], "security_id string, action_type string, event_time timestamp, effective_time timestamp, available_time timestamp, ratio_text string, amount double")
    levels = pf.total_return_levels(bars, none).orderBy("ts").collect()
    assert [round(r.level, 6) for r in levels] == [100.0, 0.0, 0.0, 0.0]
    from tidemark.sources.payloads import factor_levels

    f = spark.createDataFrame([("s", i, r) for i, r in enumerate([0.0, 0.1, -3.0, -0.5, -1.0, 0.2])], "series_id string, ts int, mkt double")
    assert [round(r.level, 6) for r in factor_levels(f, "mkt").orderBy("ts").collect()] == [100.0, 110.0, -220.0, -110.0, 0.0, 0.0]


def test_masked_composite_is_the_joined_one(spark):
    from tidemark.operators.fundamental_factors import composite, masked_composite

    moments = [datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)]
    rows = [(f"s{i}", m, None if (i + k) % 4 == 0 else float(i * 7 % 5), float(i * 3 % 4) if k < 2 or i == 1 else None) for k, m in enumerate(moments) for i in range(9)]
    scores = spark.createDataFrame(rows, "security_id string, as_of timestamp, a double, b double")
    joined = scores.join(composite(scores, ["a", "b"]), ["security_id", "as_of"], "left")
    masked = scores.withColumn("score", masked_composite(["a", "b"]))
    keyed = lambda df: {(r["security_id"], r["as_of"]): r["score"] for r in df.collect()}
    assert keyed(masked) == keyed(joined) and any(x is None for x in keyed(masked).values())
