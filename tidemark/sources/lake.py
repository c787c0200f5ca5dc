"""The bar lake: reads, idempotent appends, raw payloads and batch bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.session import prepare

BAR_KEY = ("security_id", "ts", "source", "data_version")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """All bars; columns missing in older files read back as NULL because the schema is declared."""
    return spark.read.schema(schema.BARS).option("mergeSchema", "true").parquet(path)


def bars_of(bars: DataFrame, security_id: str) -> DataFrame:
    """One security in time order; files sorted by security let row-group statistics prune the rest."""
    return bars.filter(F.col("security_id") == security_id).orderBy("ts")


def new_rows(batch: DataFrame, stored: DataFrame, key: Sequence[str] = BAR_KEY) -> DataFrame:
    """Rows of the batch to append: unique by key and not stored yet. Stored ones go first, so that only new rows are sorted out."""
    return batch.join(stored.select(*key), list(key), "left_anti").dropDuplicates(list(key))


def write_bars(rows: DataFrame, path: str) -> None:
    """Append as Parquet by year, sorted by security inside files; the commit protocol makes it atomic.

    Adaptive execution sizes the writers: a large year is split among several, small ones share one.
    """
    prepare(rows.sparkSession)
    spread = rows.withColumn("year", F.year("ts")).hint("rebalance", "year")
    spread.sortWithinPartitions("year", "security_id", "ts").write.mode("append").partitionBy("year").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def stored_for(spark: SparkSession, batch: DataFrame, path: str, years: Column, key: Sequence[str] = BAR_KEY) -> DataFrame:
    """The part of the lake that can hold rows of the batch: its years, whose number the calendar bounds, and inside them
    the range of every key column. Files are written by batch and sorted, so their statistics leave most of them unread.
    """
    ends = [f(F.col(k)).alias(f"{name}_{k}") for k in key for name, f in (("low", F.min), ("high", F.max))]
    told = batch.agg(F.array_sort(F.collect_set(years)).alias("years"), *ends).first()
    stored = spark.read.schema(batch.schema).parquet(path)
    if not told["years"] or any(told[f"low_{k}"] is None for k in key):
        return stored.where(F.lit(False))  # no row has a whole key
    held = F.col("year").isin(told["years"])
    for k in key:
        held = held & F.col(k).between(told[f"low_{k}"], told[f"high_{k}"])
    return stored.where(held)


def append_bars(spark: SparkSession, batch: DataFrame, path: str) -> None:
    """Idempotent append: rows whose key is stored already, or stands in the batch before, are not written again."""
    rows = batch.dropDuplicates(list(BAR_KEY))
    if exists(spark, path):
        rows = new_rows(batch, stored_for(spark, batch, path, F.year("ts")))
    write_bars(rows, path)


def raw_payloads(records: DataFrame, source: str, batch_id: Column, ingestion_time: Column) -> DataFrame:
    """Provider records kept as JSON text with their provenance."""
    rest = [x for x in records.columns if x != "security_id"]
    return records.select(
        "security_id", F.lit(source).alias("source"), ingestion_time.alias("ingestion_time"), batch_id.alias("batch_id"), F.to_json(F.struct(*rest)).alias("payload")
    )


def batch_manifest(payloads: DataFrame) -> DataFrame:
    return payloads.groupBy("batch_id").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("security_id").alias("securities"))


def payloads_of(payloads: DataFrame, security_id: str, record_schema: str) -> DataFrame:
    """Raw records of one security, decoded, in ingestion order."""
    one = payloads.filter(F.col("security_id") == security_id)
    return one.select("ingestion_time", F.from_json("payload", record_schema).alias("r")).select("ingestion_time", "r.*").orderBy("ingestion_time")


def incremental_start(bars: DataFrame, symbols: DataFrame, fallback: Column, days_back: int = 7) -> DataFrame:
    """Start of the next load: the oldest of the newest bars minus a week, floored; the fallback when a symbol has none."""
    last = bars.groupBy("security_id").agg(F.max("ts").alias("last"))
    g = symbols.join(last, "security_id", "left").agg(F.min("last").alias("m"), F.count_if(F.col("last").isNull()).alias("missing"))
    start = F.greatest(F.date_sub(F.to_date("m"), days_back), fallback)
    return g.select(F.when((F.col("missing") > 0) | F.col("m").isNull(), fallback).otherwise(start).alias("start"))


def run_status(manifest: DataFrame, *by: str) -> DataFrame:
    """SUCCESS, PARTIAL or FAILED over the per-symbol results."""
    n, ok = F.count(F.lit(1)), F.count_if(F.col("status") == "SUCCESS")
    return manifest.groupBy(*by).agg(F.when(ok == n, "SUCCESS").when(ok > 0, "PARTIAL").otherwise("FAILED").alias("run_status"), n.alias("symbols"))


def first_answer(answers: DataFrame) -> DataFrame:
    """Per security the source of best priority that answered without error; an empty answer counts."""
    ok = answers.filter(F.col("status") == "OK")
    return ok.groupBy("security_id").agg(F.min_by("source", "priority").alias("source"), F.min("priority").alias("priority"))


def content_version(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def write_snapshots(tables: dict[str, DataFrame], folder: str) -> None:
    """Each ledger table as JSON, replaced as a whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def write_price_files(prices: DataFrame, wanted: DataFrame, folder: str) -> None:
    """One sorted folder per requested ticker from a large price table; zero-volume rows are dropped.

    A ticker with many rows is written by several tasks.
    """
    rows = real_rows(prices).join(wanted.select("ticker"), "ticker", "left_semi")
    rows.hint("rebalance", "ticker").sortWithinPartitions("ticker", "date").write.mode("overwrite").partitionBy("ticker").option("header", True).csv(folder)


def real_rows(prices: DataFrame) -> DataFrame:
    """Rows with trades; dummy rows of zero volume go."""
    return prices.filter(F.col("volume") != 0)


def import_layout(prices: DataFrame) -> DataFrame:
    """Columns of the file-import layout, adjusted columns left blank."""
    blank = F.lit("")
    return prices.select("date", "open", "high", "low", "close", "volume", blank.alias("adj_close"), blank.alias("adj_high"), blank.alias("adj_low"))
