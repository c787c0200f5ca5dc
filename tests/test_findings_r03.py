"""Findings of the third review: one test each."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import functions as F


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_replayed_trades_shuffle_fills_once(spark, monkeypatch):
    from tidemark.operators import journal as jr
    from tidemark.operators.scans import split_large

    # security C has more fills than the limit; each cycle ends flat
    steps = [(s, k, q) for s, n in (("A", 2), ("B", 3), ("C", 9)) for k, q in enumerate([10, 5, -8, -7] * n)]
    fills = spark.createDataFrame(
        [(i, i, s, "BUY" if q > 0 else "SELL", float(abs(q)), 10.0 + (i * 7) % 11, 0.25, f"2020-01-01 00:{k:02d}:00") for i, (s, k, q) in enumerate(steps)],
        "fill_id long, order_id long, security_id string, side string, quantity double, price double, commission double, at string",
    ).select("*", F.col("at").cast("timestamp").alias("execution_time"))
    decisions = fills.select("order_id", F.col("order_id").alias("decision_id"))
    stored = fills.filter("fill_id % 5 = 0").select("fill_id")

    def shown(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())

    out = jr.replayed_trades(fills, decisions, stored)
    assert _exchanges(out) <= 5  # fills once, and both sides of two joins
    plain = shown(out)
    cost, position, at, want = {}, {}, {}, {}
    for i, s, side, q, price, fee in [(r["fill_id"], r["security_id"], r["side"], r["quantity"], r["price"], r["commission"]) for r in fills.orderBy("fill_id").collect()]:
        have = position.get(s, 0.0)
        if side == "BUY":
            cost[s] = (cost.get(s, 0.0) * have + price * q) / (have + q) if have else price
            position[s] = have + q
        else:
            want[i] = round((price - cost[s]) * q - fee, 6)
            position[s] = have - q
    assert {r[0]: r[7] for r in plain if r[4] == "SELL"} == {i: v for i, v in want.items() if i % 5}
    assert len(plain) == sum(i % 5 != 0 for i in range(len(steps)))
    monkeypatch.setattr(jr, "split_large", partial(split_large, limit=12))
    assert shown(jr.replayed_trades(fills, decisions, stored)) == plain


def test_log_of_total_return_outside_the_range_of_doubles(spark):
    from tidemark.operators import performance as pf

    days = [f"2020-{m:02d}-{d:02d}" for m in range(1, 5) for d in range(1, 29)]
    bars = spark.createDataFrame([("A", day, 100.0) for day in days], "security_id string, day string, close double")
    bars = bars.select("security_id", F.col("day").cast("timestamp").alias("ts"), "close", F.col("day").cast("timestamp").alias("available_time"))
    # twenty halvings a day: 2 ** -2220 at the end
    actions = bars.select("security_id", F.lit("REVERSE_SPLIT").alias("action_type"), F.col("ts").alias("event_time"), F.col("ts").alias("effective_time"), "available_time",
                          F.lit("0.5").alias("ratio_text"), F.lit(None).cast("double").alias("amount"), F.explode(F.sequence(F.lit(1), F.lit(20))))
    last = pf.total_return_levels(bars, actions).orderBy("ts").collect()[-1]
    assert abs(last["log_level"] - (math.log(100) - 20 * (len(days) - 1) * math.log(2))) < 1e-6


def test_order_targets_next_to_whole_numbers(spark, tmp_path):
    from tidemark.plans import load_all
    from tidemark.plans.domain import Domain
    from tidemark.plans.registry import REGISTRY

    load_all()
    at = [(k, cents / 100) for k in range(1, 60) for cents in range(0, 1000000, 997) if k % 11]
    near = [(k, a) for k, a in at if math.floor(k % 11 / 10 * (a * 10) / (20 + k % 30)) != math.floor(k % 11 / 10 * a * 10 / (20 + k % 30))]
    assert near
    rows = [(k + 1650 * i, -a) for i, (k, a) in enumerate(near)]  # of the same remainders
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["id"]: r["delta"] for r in REGISTRY["top_06_order_chunks"].build(Domain(spark, str(tmp_path))).select("id", "delta").distinct().collect()}
    want = {k: math.floor(k % 11 / 10 * abs(a) * 10 / (20 + k % 30)) - k % 500 for k, a in rows}
    assert got == {k: float(v) for k, v in want.items() if v}


MARK = "realized_return <> 123456.5"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fill_audit_counts_no_distinct_values(spark):
    from tidemark.operators import quality as dq

    rows = [(1, "A", "2020-01-02", "x", "2020-01-01"), (2, "A", "2020-01-02", "y", "2020-01-01"), (3, "B", "2020-01-02", "x", "2020-01-01"), (4, "B", "2020-01-02", None, "2020-01-01")]
    fills = spark.createDataFrame(rows, "order_id long, security_id string, fill_time string, data_version string, decision_time string")
    fills = fills.withColumn("fill_time", F.col("fill_time").cast("timestamp")).withColumn("decision_time", F.col("decision_time").cast("timestamp"))
    out = dq.fill_audit(fills)
    assert "distinct" not in _plan(out).lower()
    assert [tuple(r) for r in out.collect()] == [("mixed_data_version", "A@2020-01-02")]


def test_stored_rows_leave_before_duplicates(spark):
    from tidemark.sources import lake

    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k long, v string")
    out = lake.new_rows(batch, batch.filter("k = 3"), ["k"])
    plan = _plan(out)
    assert plan.index("Aggregate") < plan.index("Join")
    assert sorted(r["k"] for r in out.collect()) == [1, 2]


def test_study_reads_prices_once(spark, sf_dir):
    from tidemark.operators import news as nw
    from tidemark.plans.domain import Domain

    d = Domain(spark, sf_dir)
    prices = nw.adjusted_closes(d.bars).filter("px <> 123456.5")
    assert "123456.5" not in _plan(nw.excess_returns(nw.first_per_day(d.news, d.sector), prices))


def test_checks_read_bars_once(spark, sf_dir):
    from tidemark.operators import quality as dq
    from tidemark.plans import load_all
    from tidemark.plans import queries_quality as qq
    from tidemark.plans.domain import Domain

    load_all()
    d = Domain(spark, sf_dir)
    bars = qq.faulty(d, False).filter("close <> 123456.5")
    assert "123456.5" not in _plan(dq.run_checks(qq.faulty(d), bars, d.actions, qq.known(d), qq.now(), qq.minimum(d)))


def test_splits_of_a_day_are_joined_as_one(spark, sf_dir):
    from tidemark.operators import holdings as hd
    from tidemark.plans.domain import QUARTERS, Domain

    d = Domain(spark, sf_dir)
    plan = _plan(hd.split_adjusted_holdings(d.holdings, d.actions, QUARTERS))
    assert "sum(ln(" in plan.lower() and "log_ratio" in plan


def test_training_dataset_reads_records_once(spark):
    from tidemark.operators import journal as jr

    cleaned = spark.createDataFrame([(i, "VALID", f"2020-01-{i + 1:02d}", i / 10) for i in range(10)], "trade_id long, status string, day string, realized_return double")
    out = jr.training_dataset(cleaned.withColumn("sample_time", F.col("day").cast("timestamp")).filter(MARK))
    assert "123456.5" not in _plan(out)
    assert [r["split"] for r in out.orderBy("place").collect()] == ["TRAIN"] * 6 + ["VALIDATION"] * 2 + ["TEST"] * 2


def test_information_table_is_parsed_once(spark):
    import pytest

    from tidemark.sources import payloads as pl

    def table(*texts):
        return pl.info_table(spark.createDataFrame(list(enumerate(texts)), "accession long, xml string").repartition(2))

    row = "<infoTable><nameOfIssuer>{}</nameOfIssuer><cusip>{}</cusip><shrsOrPrnAmt><sshPrnamt>{}</sshPrnamt></shrsOrPrnAmt></infoTable>"
    out = table(row.format("A &amp; B", "000000001", "5"), row.format("<![CDATA[C]]><!-- x -->", "02", "7.5"))
    assert out._jdf.queryExecution().executedPlan().toString().count("from_xml(") == 1
    assert sorted(map(tuple, out.collect())) == [(0, "000000001", "A & B", 5.0), (1, "02", "C", 7.5)]
    for bad in (None, "", "<infoTable>", row.format("A", "1", "2").replace("cusip", "other")):
        with pytest.raises(Exception, match="an information table row lacks a field"):
            table(row.format("A", "1", "2"), bad).select("accession").collect()
