"""Helpers of the training-data operators that concern Spark: shared tables, samples, safe column names."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

HASH_UNITS = 1 << 30
PART = re.compile(r"/part-(\d+)[^/]*$")


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in one folder for each value of ``by``, and read it back.

    The lineage of what follows ends in files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def forget(df: DataFrame, *parts: str) -> None:
    """Remove a table of :func:`materialise`, or parts of it, that no later plan reads."""
    for name in parts or ("",):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{df.shared_path}/{name}".rstrip("/"))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and a column ``name``: the number of each row in the order in which its files were written, from 0.

    Rows read from files have the same number whenever they are read. Files of a write are ordered by their part
    number, others by name; rows that come from no file are written first.
    """
    try:
        place = docs.metadataColumn("_metadata")
        found = docs.select(place["file_path"].alias("file"), place["row_index"].alias("at"))
    except AnalysisException:
        return numbered(materialise(docs, "numbered"), name)
    sizes = [(r["file"], r["n"]) for r in found.groupBy("file").agg((F.max("at") + 1).alias("n")).collect()]
    part = lambda f: (int(m[1]) if (m := PART.search(f)) else 0, f)
    starts, start = [], 0
    for f, n in sorted(sizes, key=lambda x: part(x[0])):
        starts.append((f, start))
        start += n
    file, before = free_name(docs, "file_of_row"), free_name(docs, "rows_before")
    heads = docs.sparkSession.createDataFrame(starts, f"{file} string, {before} long")
    rows = docs.withColumns({file: place["file_path"], name: place["row_index"]}).join(F.broadcast(heads), file)
    return rows.withColumn(name, F.col(name) + F.col(before)).drop(file, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary"))


def hash_unit(*cols: str | Column) -> Column:
    """A number from 0 to HASH_UNITS - 1 drawn by hashing, the same in every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(HASH_UNITS))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
