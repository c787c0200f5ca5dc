"""Writers, streaming forms and the registry."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_semantics import BAR, bar
from tidemark.operators import performance as pf
from tidemark.sources import lake
from tidemark.streaming import jobs


def test_append_is_idempotent_and_old_files_read_back_null(spark, tmp_path):
    path = str(tmp_path / "lake")
    rows = [bar("A", datetime(2024, 1, i), 10.0 + i) for i in range(1, 9)]
    df = spark.createDataFrame(rows + rows[:3], BAR)
    lake.append_bars(spark, df, path)
    lake.append_bars(spark, df, path)
    assert lake.read_bars(spark, path).count() == 8
    df.limit(1).withColumn("security_id", F.lit("B")).drop("adjusted_low").write.mode("append").parquet(f"{path}/year=2024")
    assert lake.read_bars(spark, path).filter("security_id = 'B'").first().adjusted_low is None


def test_price_files_per_ticker(spark, tmp_path):
    rows = [("A", "2024-01-02", 1.0, 1.0, 1.0, 1.0, 5.0), ("A", "2024-01-01", 1.0, 1.0, 1.0, 1.0, 0.0), ("B", "2024-01-01", 1.0, 1.0, 1.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "ticker string, date string, open double, high double, low double, close double, volume double")
    lake.write_price_files(df, df.select("ticker").filter("ticker = 'A'").distinct(), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1


def _write_batches(spark, folder, rows, schema, cuts):
    for n, (a, b) in enumerate(cuts):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{folder}/b{n}")
        yield


def test_stream_ingest_over_several_batches(spark, tmp_path):
    rows = [bar("A", datetime(2024, 1, 1) + timedelta(days=i), float(i)) for i in range(10)]
    for cuts in ([(0, 6)], [(3, 10)], [(0, 10)]):
        for _ in _write_batches(spark, str(tmp_path / f"in{cuts[0]}"), rows, BAR, cuts):
            pass
        src = str(tmp_path / f"in{cuts[0]}" / "*")
        s = spark.readStream.schema(BAR).parquet(src)
        jobs.start_ingest(s, str(tmp_path / "lake"), str(tmp_path / f"ck{cuts[0]}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "lake")).count() == 10


def test_stream_streaks_equal_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [("a" if rng.random() < 0.8 else "b", i, float(rng.choice([-1, 1]))) for i in range(90)]
    schema = "grp string, o int, realized_pnl double"
    state, ck = str(tmp_path / "state"), str(tmp_path / "ck")
    for _ in _write_batches(spark, str(tmp_path / "in"), rows, schema, [(0, 40), (40, 41), (41, 90)]):
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        jobs.start_streaks(s, state, ck, ["o"]).awaitTermination()
    assert jobs.spans(spark, state) == [(0, 0), (1, 1), (2, 2)]
    got = jobs.read_streaks(spark, state).select("grp", "max_wins", "max_losses")
    want = pf.streaks(spark.createDataFrame(rows, schema), ["grp"], ["o"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("grp", "max_wins", "max_losses").collect()))


def test_stream_newest_equals_batch(spark, tmp_path):
    rows = [(f"k{i % 3}", i * 7 % 20, float(i)) for i in range(20)]
    schema = "k string, o int, v double"
    ck = str(tmp_path / "ck")
    for _ in _write_batches(spark, str(tmp_path / "in"), rows, schema, [(0, 9), (9, 20)]):
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        jobs.start_newest(s, ck, ["k"], ["o"]).awaitTermination()
    assert jobs.read_newest(spark, ck).columns == ["k", "o", "v"]
    got = {r.k: r.v for r in jobs.read_newest(spark, ck).collect()}
    assert got == {k: max((o, v) for kk, o, v in rows if kk == k)[1] for k in ("k0", "k1", "k2")}


def test_registry_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 450 and set(o) <= set(q)
    assert all(not text.rstrip().endswith(";") for text in o.values())


def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 1 and "mean_ic" in df.columns


@pytest.mark.parametrize("name", ["fpx_01_low_volatility", "ffn_07_roe", "jon_22_prediction_as_of", "win_13_performance_report", "src_08_csv_bars"])
def test_queries_match_their_sql_on_the_smallest_scale(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=key)
    assert got == want


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = entry.queries()["fpx_08_fifty_two_week_high"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    lineitem = [p for p in plan.split("ReadSchema: ") if p.startswith("struct<l_orderkey")]
    assert lineitem and all("l_extendedprice" not in p.split(">")[0] for p in lineitem)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_late_rows_reach_the_lake_once(spark, tmp_path):
    rows = [bar("A", datetime(2024, 3, 1) + timedelta(days=i), float(i)) for i in range(10)]
    late = [bar("A", datetime(2023, 6, 1) + timedelta(days=i), float(i)) for i in range(5)]
    feeds = [rows, late + rows[:3], late]
    lake_path, ck, src = str(tmp_path / "lake"), str(tmp_path / "ck"), tmp_path / "in"
    for n, feed in enumerate(feeds):
        spark.createDataFrame(feed, BAR).coalesce(1).write.parquet(str(src / f"b{n}"))
        s = spark.readStream.schema(BAR).parquet(str(src / "*"))
        jobs.start_ingest(s, lake_path, ck).awaitTermination()
    assert spark.read.parquet(lake_path).count() == 15


def test_append_reads_only_the_batch_years(spark, tmp_path):
    path = str(tmp_path / "lake")
    lake.append_bars(spark, spark.createDataFrame([bar("A", datetime(y, 1, 2), 1.0) for y in (2020, 2021, 2022)], BAR), path)
    again = spark.createDataFrame([bar("A", datetime(2021, 1, 2), 1.0), bar("A", datetime(2021, 1, 3), 1.0)], BAR)
    plan = lake.stored_for(spark, again, path, F.year("ts"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "year" in plan.split("PartitionFilters")[1][:60]
    lake.append_bars(spark, again, path)
    assert lake.read_bars(spark, path).count() == 4


def test_late_windows_are_counted(spark, tmp_path):
    schema = "ts timestamp, kind string, v double"
    feeds = [[(datetime(2024, 1, 5, h), "a", float(h)) for h in range(6)], [(datetime(2023, 1, 1, h), "a", 9.0) for h in range(3)]]
    for n, feed in enumerate(feeds):
        spark.createDataFrame(feed, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        jobs.start_quality_windows(s, str(tmp_path / "out"), str(tmp_path / "ck"), "ts", "kind", F.col("v") > 4).awaitTermination()
    got = jobs.quality_windows(jobs.read_counts(spark, str(tmp_path / "out")), "kind").collect()
    assert sorted((r["start"], r["n"], r["bad_rate"]) for r in got) == [(datetime(2023, 1, 1), 3, 1.0), (datetime(2024, 1, 5), 6, 1 / 6)]


def test_counts_of_many_batches_are_few_parts(spark, tmp_path):
    schema, out, ck = "ts timestamp, kind string, v double", str(tmp_path / "out"), str(tmp_path / "ck")
    for n in range(11):
        spark.createDataFrame([(datetime(2024, 1, 1 + n % 3), "a", float(n))], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    jobs.start_quality_windows(s, out, ck, "ts", "kind", F.col("v") > 4, fan_in=3).awaitTermination()
    assert jobs.spans(spark, out) == [(0, 8), (9, 9), (10, 10)]
    told = lambda: {r["start"].day: (r["n"], round(r["bad_rate"] * r["n"])) for r in jobs.quality_windows(jobs.read_counts(spark, out), "kind").collect()}
    assert told() == {1: (4, 2), 2: (4, 2), 3: (3, 2)}
    # the last commit is lost: batch 10 is replayed; then one whose longer part was written but not acknowledged
    (tmp_path / "ck" / "commits" / "10").unlink()
    (tmp_path / "ck" / "commits" / ".10.crc").unlink(missing_ok=True)
    jobs.start_quality_windows(s, out, ck, "ts", "kind", F.col("v") > 4, fan_in=11).awaitTermination()
    assert jobs.spans(spark, out) == [(0, 10)] and told() == {1: (4, 2), 2: (4, 2), 3: (3, 2)}
    (tmp_path / "ck" / "commits" / "10").unlink()
    (tmp_path / "ck" / "commits" / ".10.crc").unlink(missing_ok=True)
    jobs.start_quality_windows(s, out, ck, "ts", "kind", F.col("v") > 4, fan_in=11).awaitTermination()
    assert jobs.spans(spark, out) == [(0, 10)] and told() == {1: (4, 2), 2: (4, 2), 3: (3, 2)}


def test_append_reads_only_what_can_hold_a_key(spark, tmp_path):
    path = str(tmp_path / "lake")
    for month in range(1, 7):
        days = [bar(s, datetime(2021, month, day), 1.0) for day in range(1, 21) for s in ("A", "B", "C")]
        lake.append_bars(spark, spark.createDataFrame(days, BAR), path)
    batch = spark.createDataFrame([bar("B", datetime(2021, 4, 20), 1.0), bar("B", datetime(2021, 4, 25), 1.0)], BAR)
    held = lake.stored_for(spark, batch, path, F.year("ts"))
    assert {r["ts"].month for r in held.select("ts").collect()} == {4} and {r["security_id"] for r in held.collect()} == {"B"}
    # one file a month: the other five are left out by their statistics, before a row of them is read
    scan = held._jdf.queryExecution().executedPlan().collectLeaves().head()
    held.collect()
    assert scan.metrics().apply("numOutputRows").value() == 60
    lake.append_bars(spark, batch, path)
    assert lake.read_bars(spark, path).count() == 361
    assert lake.stored_for(spark, batch.limit(0), path, F.year("ts")).count() == 0
    nothing = batch.withColumn("security_id", F.lit(None).cast("string"))
    assert lake.stored_for(spark, nothing, path, F.year("ts")).count() == 0


def _forget_commit(checkpoint, number):
    (checkpoint / "commits" / str(number)).unlink()
    (checkpoint / "commits" / f".{number}.crc").unlink(missing_ok=True)


def test_newest_touches_only_the_keys_of_a_batch(spark, tmp_path):
    ck, schema, updated = str(tmp_path / "ck"), "k string, o int", []
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    for n, feed in enumerate([[(f"k{i}", 1) for i in range(50)] + [(None, 4)], [("k7", 2), (None, None)], [("k7", 3)], [("k7", 0), ("k8", None)]]):
        spark.createDataFrame(feed, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
        q = jobs.start_newest(stream(), ck, ["k"], ["o"])
        q.awaitTermination()
        updated.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress))
    assert updated == [51, 2, 1, 2]
    want = {f"k{i}": 3 if i == 7 else 1 for i in range(50)} | {None: 4}
    told = lambda: {r["k"]: r["o"] for r in jobs.read_newest(spark, ck).collect()}
    assert told() == want
    _forget_commit(tmp_path / "ck", 3)  # the last batch is replayed
    jobs.start_newest(stream(), ck, ["k"], ["o"]).awaitTermination()
    assert told() == want


def test_streaks_of_many_batches_are_few_parts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), i, rng.choice([-1.0, 1.0, 1.0])) for i in range(60)] + [("c", 60, 1.0), ("c", 61, 1.0)]
    schema, path, ck = "grp string, o int, realized_pnl double", str(tmp_path / "s"), str(tmp_path / "ck")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for n, at in enumerate(range(0, 62, 6)):
        spark.createDataFrame(rows[at : at + 6], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n:02d}"))
        jobs.start_streaks(stream(), path, ck, ["o"], fan_in=3).awaitTermination()
    want = sorted(map(tuple, pf.streak_summary(spark.createDataFrame(rows, schema), ["grp"], ["o"]).collect()))
    assert jobs.spans(spark, path) == [(0, 8), (9, 9), (10, 10)]
    assert sorted(map(tuple, jobs.read_streaks(spark, path).collect())) == want
    _forget_commit(tmp_path / "ck", 10)
    jobs.start_streaks(stream(), path, ck, ["o"], fan_in=11).awaitTermination()
    assert jobs.spans(spark, path) == [(0, 10)]
    assert sorted(map(tuple, jobs.read_streaks(spark, path).collect())) == want


def test_csv_folder(spark, tmp_path):
    from tidemark.sources.payloads import csv_files

    head = "date,open,high,low,close,volume,adj_close\n"
    for name, close in (("AAA", 1.5), ("B-B", 2.5)):
        (tmp_path / f"{name}.csv").write_text(head + f"2024-01-02,1,2,1,{close},10,\n")
    assert sorted((r.security_id, r.close, r.adj_close) for r in csv_files(spark, str(tmp_path)).collect()) == [("AAA", 1.5, None), ("B-B", 2.5, None)]


def test_locked_window_raises(spark):
    from tidemark.functions.scalars import guard_locked

    windows = spark.createDataFrame([("g", datetime(2024, 1, 1), datetime(2024, 2, 1))], "window_name string, window_start timestamp, window_end timestamp")
    schema = "grp string, start timestamp, end timestamp"
    free = [("g", datetime(2024, 2, 1), datetime(2024, 3, 1)), ("h", datetime(2024, 1, 5), datetime(2024, 1, 6))]
    assert guard_locked(spark.createDataFrame(free, schema), windows).count() == 2
    with pytest.raises(Exception, match="locked window"):
        guard_locked(spark.createDataFrame([*free, ("g", datetime(2024, 1, 31), datetime(2024, 3, 1))], schema), windows).collect()
