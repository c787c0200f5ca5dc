"""Streaming forms of four batch jobs; each gives the batch result on the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.performance import chain_streaks, streak_summary
from tidemark.session import prepare
from tidemark.sources.lake import BAR_KEY, exists, new_rows, stored_for


def start_ingest(bars: DataFrame, lake_path: str, checkpoint: str, key=BAR_KEY, year: Column | None = None) -> StreamingQuery:
    """Append a stream of bars to the lake, however late they come; a key is stored once.

    ``year`` is the partition of a row, a function of its key. Each batch is made unique and held against the stored
    rows of its own years and key ranges alone. A batch replayed after a failure finds its own rows and appends nothing twice.
    """
    year = F.year("ts") if year is None else year

    def save(batch: DataFrame, _: int) -> None:
        spark = prepare(batch.sparkSession)
        rows = batch.dropDuplicates(list(key))
        if exists(spark, lake_path):
            rows = new_rows(batch, stored_for(spark, batch, lake_path, year, key), key)
        rows.withColumn("year", year).hint("rebalance", "year").sortWithinPartitions("year", *key).write.mode("append").partitionBy("year").parquet(lake_path)

    return bars.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a batch uploads its changes, not the store
}


def start_newest(rows: DataFrame, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Keep the newest revision per key, by ``order`` and then by the other columns, as keyed state in the checkpoint.

    A batch is reduced to one row per key before its shuffle, reads and writes the state of its own keys alone and saves
    these changes; a replayed batch starts from the state before it. A null order is older than any other.
    """
    for name, value in STATE.items():
        rows.sparkSession.conf.set(name, value)
    rest = [x for x in rows.columns if x not in keys and x not in order]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("newest"))
    return newest.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_newest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The table as it stands after the last finished batch, from the state of :func:`start_newest`."""
    for name, value in STATE.items():
        spark.conf.set(name, value)
    return spark.read.format("statestore").load(checkpoint).select("key.*", "value.*").select("*", "max.*").drop("max")


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = _files(spark, path)
    fs.delete(hadoop, True)


def quality_counts(rows: DataFrame, time: str, by: str, bad, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Rows and bad rows per tumbling (or sliding) window of event time; counts of parts add up."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    g = rows.groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "bad")


FAN_IN = 32  #: so many parts of counts are added up to one


def _span(path: str, first: int, last: int) -> str:
    return f"{path}/first={first}/last={last}"


def spans(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last batch) of the finished parts, without those that a longer part covers."""
    fs, hadoop = _files(spark, f"{path}/first=*/last=*/_SUCCESS")
    found = [tuple(int(x.split("=")[1]) for x in status.getPath().toString().split("/")[-3:-1]) for status in fs.globStatus(hadoop) or []]
    out: list[tuple[int, int]] = []
    for first, last in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or first > out[-1][1]:
            out.append((first, last))
    return out


def read_parts(spark: SparkSession, path: str, parts: list[tuple[int, int]]) -> DataFrame:
    """The rows of these parts, with the columns first and last of their batches."""
    return spark.read.option("basePath", path).parquet(*[_span(path, *x) for x in parts])


def _add_up(spark: SparkSession, path: str, number: int, merge: Callable[[DataFrame], DataFrame], fan_in: int) -> None:
    """Replace every full run of ``fan_in`` parts that ends with batch ``number`` by one part."""
    width = fan_in
    while (number + 1) % width == 0:
        first = number + 1 - width
        parts = [x for x in spans(spark, path) if first <= x[0]]
        if len(parts) > 1:
            merge(read_parts(spark, path, parts)).write.mode("overwrite").parquet(_span(path, first, number))
        for part in parts:
            if part != (first, number):
                remove(spark, _span(path, *part))
        width *= fan_in


def _start_parts(rows: DataFrame, path: str, checkpoint: str, summary: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], fan_in: int) -> StreamingQuery:
    """Write the summary of each batch under the batch's number: a replay overwrites its own part.

    Parts of ``fan_in`` batches are merged to one, and ``fan_in`` of these again, so that a reader opens fewer than
    ``fan_in`` parts for each power of it, and a row is written again once for each power. A part is named by its batches
    and takes the place of shorter ones when it is finished; a replayed batch that lies in a longer part is in it already.
    """
    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not any(first <= number <= last and first < last for first, last in spans(spark, path)):
            summary(batch).write.mode("overwrite").parquet(_span(path, number, number))
        _add_up(spark, path, number, merge, fan_in)

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_quality_windows(
    rows: DataFrame, path: str, checkpoint: str, time: str, by: str, bad, width: str = "1 day", slide: str | None = None, fan_in: int = FAN_IN
) -> StreamingQuery:
    """Count each batch by window, late rows too; counts of many batches are added up to few parts."""
    merge = lambda parts: parts.groupBy("start", "end", by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return _start_parts(rows, path, checkpoint, lambda batch: quality_counts(batch, time, by, bad, width, slide), merge, fan_in)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of all batches so far, each batch once."""
    return read_parts(spark, path, spans(spark, path)).drop("first", "last")


def quality_windows(counts: DataFrame, by: str) -> DataFrame:
    """Rows and share of bad rows per window from the counts of all batches."""
    g = counts.groupBy("start", "end", by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return g.select("start", "end", by, "n", (F.col("bad") / F.col("n")).alias("bad_rate"))


def start_streaks(trades: DataFrame, path: str, checkpoint: str, order: list[str], fan_in: int = FAN_IN) -> StreamingQuery:
    """Longest win and loss runs per ``grp`` over trades that arrive in time order from batch to batch.

    A batch is summed up in pieces, so one large group spreads over tasks, and only the groups of the batch are written;
    summaries of many batches are chained to few parts.
    """
    return _start_parts(trades, path, checkpoint, lambda batch: streak_summary(batch, ["grp"], order), lambda parts: chain_streaks(parts, ["grp"], "first"), fan_in)


def read_streaks(spark: SparkSession, path: str) -> DataFrame:
    """The summary of each group over all batches so far."""
    return chain_streaks(read_parts(spark, path, spans(spark, path)), ["grp"], "first")
