"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the engine wants from any session. Shuffle width is left to the cluster (AQE coalesces it).
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows carry whole files, so Arrow batches are bounded by bytes rather than by row count.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 2**20),
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "filetrail", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; `extra` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Where none is named, a local folder, on one machine only."""
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where one result feeds several branches of a plan, or where an iterative job would grow its
    lineage. The written table survives lost executors, is columnar, and gives the optimizer sizes.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/filetrail/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, most: int = 8 << 20) -> Iterator[None]:
    """Jobs run inside hand at most about `most` bytes at a time to Python workers; what the session had is put back.

    A batch is held by the JVM and by the worker, in several copies while it grows, and each core of an executor has one.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for expensive work per row on a scan with fewer partitions than cores.

    Larger scans already have enough partitions and are left alone, so big data is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
