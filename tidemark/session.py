"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


PINNED = {
    "spark.sql.session.timeZone": "UTC",  # every timestamp in the library is UTC
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",  # the default type has no statistics in files
}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what the operators rely on: the session zone, and times that files keep ranges of."""
    for name, value in PINNED.items():
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; only a local run without one gets a scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get(CHECKPOINT_KEY, None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    sc.setCheckpointDir(shared)
    return shared


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
