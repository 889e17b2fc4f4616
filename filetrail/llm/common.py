"""Small helpers that the operators share: tables, staging, partition counts, a store per worker process."""

from __future__ import annotations

import ctypes
import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filetrail.session import stage

__all__ = ["bytes_of", "crc_u32", "lean", "parts_for", "remove", "screened", "stage", "table", "texts_of", "worker_store"]

PART_BYTES = 32 << 20
SCREEN_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the worker process.

    Functions travel to executors by value and get fresh globals in every task, so what is worth keeping between
    tasks (vocabularies, memos) is kept in a module of its own.
    """
    module = sys.modules.setdefault("filetrail_worker_store", types.ModuleType("filetrail_worker_store"))
    return vars(module).setdefault(name, {})


def keep_stores(*names: str) -> None:
    """Drop what earlier work of this process left in other stores, and give free memory back to the system."""
    module = sys.modules.get("filetrail_worker_store")
    others = [n for n, held in vars(module).items() if isinstance(held, dict) and not n.startswith("__") and n not in names] if module else []
    for name in others:
        delattr(module, name)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries keep freed memory and have this
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator], *stores: str) -> Callable[[Iterator], Iterator]:
    """`run`, over a task's batches, with no other stores than `stores` in the worker process and no free memory held after it.

    Workers are used again by the steps that follow, and by default an executor keeps all it ever had; what each holds from steps that are done
    with adds up beside the JVM.
    """
    def held(batches: Iterator) -> Iterator:
        keep_stores(*stores)
        try:
            yield from run(batches)
        finally:
            keep_stores(*stores)

    return held


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; nulls are empty."""
    return [t or "" for t in column.to_pylist()]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of an Arrow string column and where each row starts (one more entry than rows)."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def crc_u32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def parts_for(spark: SparkSession, n_bytes: int | None, per_part: int = PART_BYTES) -> int:
    """Partitions for `n_bytes` of data: the session's shuffle width, and more where that is too coarse."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(width, -(-int(n_bytes or 0) // per_part))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.select(F.sum(F.octet_length(column))).first()[0] or 0


def screened(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """`rows` with `may`: false where `key` is surely not among `wanted`'s, so that an exact join need not move these rows.

    What is broadcast are the bits of a table of fixed size, whatever the data; keys that share a bit let more rows through.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(SCREEN_BITS))
    words = wanted.select(bit.alias("__bit")).select(
        F.expr("__bit div 64").alias("__word"), F.expr("shiftleft(1L, cast(__bit % 64 as int))").alias("__held")).groupBy("__word").agg(
        F.bit_or("__held").alias("__held"))
    placed = rows.withColumn("__bit", bit).withColumn("__word", F.expr("__bit div 64"))
    may = F.expr("coalesce(getbit(__held, cast(__bit % 64 as int)), 0) = 1")
    return placed.join(F.broadcast(words), "__word", "left").select(*rows.columns, may.alias("may"))


def remove(df: DataFrame) -> None:
    """Delete a staged table that no later step reads."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
