"""Spark session settings, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE splits skewed join partitions even where that costs one more shuffle, and sizes
# partitions by bytes rather than by core count; where every partition of a join's smaller
# side turns out small, facts are hashed and not sorted. A first write that failed leaves
# scratch files at the table's place; the next run may write over them. The Python line of
# every column expression is not recorded, as that costs JVM round trips while a plan is built.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.legacy.allowNonEmptyLocationInCTAS": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Enough for shuffles of tens of terabytes at the advisory size, and little work for AQE to merge.
INITIAL_PARTITIONS = 20_000


def build_session(
    app: str = "tradewind",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with the settings above. On a cluster leave ``master`` to spark-submit. Shuffles
    begin with INITIAL_PARTITIONS, which AQE merges to partitions of the advisory size;
    ``shuffle_partitions`` takes another number, a small one for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    else:
        builder = builder.config(
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(INITIAL_PARTITIONS)
        )
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder path under ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own machine; a cluster session without it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tradewind-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
