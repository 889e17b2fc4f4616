"""Tables that grow batch by batch in levels: small runs of single batches, merged into larger runs, read by bucket.

A run holds the rows of a range of batches, partitioned by a bucket of its key columns, in a folder of its own. It counts once its writer
has left a success mark, is never changed, and only a batch that is replayed writes its own run again. Every `fan` runs of a level
are merged, so a row is rewritten once a level (the logarithm of the number of batches) and a reader opens at most `fan` runs a level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
FAN = 8


@dataclass(frozen=True)
class Levels:
    """`fold` takes the rows of some runs to fewer rows with the same meaning; `keys` say in which bucket a row lies."""

    path: str
    keys: tuple[str, ...]
    fold: Callable[[DataFrame], DataFrame]
    fan: int = FAN
    buckets: int = BUCKETS

    def bucket(self, names: dict[str, str] | None = None) -> Column:
        """Bucket of a row; `names` are the columns that hold the keys where they are called otherwise."""
        return F.pmod(F.xxhash64(*((names or {}).get(k, k) for k in self.keys)), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets in which rows with these keys lie: a list no longer than the number of buckets."""
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def runs(self, spark: SparkSession, before: int) -> list[tuple[int, int]]:
        """The fewest finished runs, as (first batch, last batch), that hold all batches before this one."""
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        ranges = []
        for status in fs.listStatus(root):
            first, _, last = status.getPath().getName().partition("-")
            if fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                ranges.append((int(first), int(last)))
        chosen: list[tuple[int, int]] = []
        for first, last in sorted(ranges, key=lambda r: (r[0], -r[1])):
            if last < before and (not chosen or first > chosen[-1][1]):
                chosen.append((first, last))
        return chosen

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write a batch's own run; a batch that is replayed replaces it."""
        self._write(rows, batch, batch)

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/{first}-{last}")

    def compact(self, spark: SparkSession, batch: int, schema: T.StructType) -> None:
        """Merge what is due before this batch. Merged runs depend on earlier batches only, so a replay finds them done."""
        width = self.fan
        while width <= batch:
            last = batch // width * width - 1
            inside = [r for r in self.runs(spark, last + 1) if r[0] > last - width]
            if len(inside) > 1:
                self._write(self.fold(self._open(spark, inside, schema)), last - width + 1, last)
            width *= self.fan

    def _open(self, spark: SparkSession, runs: Iterable[tuple[int, int]], schema: T.StructType, touched: list[int] | None = None) -> DataFrame:
        wide = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        rows = spark.createDataFrame([], schema)
        for first, last in runs:
            run = spark.read.schema(wide).parquet(f"{self.path}/{first}-{last}")
            rows = rows.unionByName((run if touched is None else run.filter(F.col("bucket").isin(touched))).drop("bucket"))
        return rows

    def read(self, spark: SparkSession, before: int, schema: T.StructType, touched: list[int] | None = None) -> DataFrame:
        """Rows of all batches before this one, folded; with `touched` only files of these buckets are opened."""
        return self.fold(self._open(spark, self.runs(spark, before), schema, touched))
