"""The results table: prior files, point reads, insert-or-replace, JSON records, graph export.

Results are parquet, partitioned by a hash bucket of the session, so that reading a session touches one bucket. Files of a bucket
are never changed: a write adds a version of the buckets that it touches, and a manifest, one small file, says which version of each
bucket counts. Readers and failed writers therefore see the table as it was before a write or after it, never in between.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filetrail.operators.ordered import upsert_latest
from filetrail.session import stage

BUCKETS = 256
PRIOR_COLUMNS = [
    "file_id", "filename", "sha256", "phash", "dhash", "ahash", "whash", "width", "height", "pipeline_matches",
    "descriptors",
]


def bucket(session: Column | str = "session_id", buckets: int = BUCKETS) -> Column:
    session = F.col(session) if isinstance(session, str) else session
    return F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int")


def prior_files(results: DataFrame, session: str) -> DataFrame:
    """The candidates of a session in upload order; only the columns matching needs."""
    kept = [c for c in PRIOR_COLUMNS if c in results.columns]
    rows = results.filter(F.col("session_id") == session)
    if "session_bucket" in results.columns:
        rows = rows.filter(F.col("session_bucket") == bucket(F.lit(session)))
    return rows.select("arrival", *kept).orderBy("arrival")


def lookup_result(results: DataFrame, session: str, file_id: str) -> DataFrame:
    """One result, or no row."""
    rows = results.filter((F.col("session_id") == session) & (F.col("file_id") == file_id))
    if "session_bucket" in results.columns:
        rows = rows.filter(F.col("session_bucket") == bucket(F.lit(session)))
    return rows


def lookup_results(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Many point reads at once: `wanted` (session_id, file_id, ...) with the result columns, NULL if absent."""
    return wanted.join(results, ["session_id", "file_id"], "left")


def to_result_json(df: DataFrame, keys: list[str], out: str = "analysis_json") -> DataFrame:
    """The row as JSON text, beside its keys. NULL fields are written."""
    return df.select(*keys, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(out))


def from_result_json(df: DataFrame, schema: T.StructType | str, text: str = "analysis_json") -> DataFrame:
    return df.select(F.from_json(text, schema).alias("r")).select("r.*")


class ConflictError(RuntimeError):
    """Other writers kept changing the same buckets."""


class _Manifests:
    """The numbered manifests of a table; the highest one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.folder = self.jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.folder.getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def latest(self) -> tuple[int, dict[int, str]]:
        """Its number (-1 for a table without any) and the version of each bucket."""
        if not self.fs.exists(self.folder):
            return -1, {}
        names = [status.getPath().getName() for status in self.fs.listStatus(self.folder)]
        number = max((int(n) for n in names if n.isdigit()), default=-1)
        return number, self.read(number)

    def read(self, number: int) -> dict[int, str]:
        if number < 0:
            return {}
        stream = self.fs.open(self._at(str(number)))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def commit(self, number: int, versions: dict[int, str]) -> bool:
        """Publish a manifest by one rename that never replaces; False if that number is taken."""
        draft = self._at(f"_{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), self.conf)
        plain = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(plain.getClass(), 1)
        options[0] = plain
        try:
            context.rename(draft, self._at(str(number)), options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.toString():
                raise
            self.fs.delete(draft, False)
            return False
        return True


def _versions(spark: SparkSession, path: str, versions: dict[int, str], schema: T.StructType) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField("version", T.StringType()), T.StructField("session_bucket", T.IntegerType())])
    folders = [f"{path}/data/version={v}/session_bucket={b}" for b, v in sorted(versions.items())]
    rows = spark.read.schema(wide).option("basePath", f"{path}/data").parquet(*folders) if folders else spark.createDataFrame([], wide)
    return rows.drop("version")


def read_results(spark: SparkSession, path: str, schema: T.StructType, number: int | None = None) -> DataFrame:
    """The results table, as of now or of manifest `number`; `schema` is that of the rows written, the bucket is added."""
    manifests = _Manifests(spark, path)
    return _versions(spark, path, manifests.latest()[1] if number is None else manifests.read(number), schema)


def write_results(results: DataFrame, path: str, buckets: int = BUCKETS, attempts: int = 5) -> int:
    """Insert-or-replace on (session_id, file_id), atomic; returns the number of the new manifest.

    Only the buckets of the new rows are read, merged and written again, so a small write does not rewrite a large table. Writing the
    same rows again changes no row. If another writer commits first, its manifest is taken over where it changed other buckets,
    and the merge is done again where it changed the same ones. A file system whose rename replaces files needs a single writer.
    """
    spark = results.sparkSession
    fresh = stage(results.withColumn("session_bucket", bucket(buckets=buckets)), "incoming")
    touched = [r[0] for r in fresh.select("session_bucket").distinct().collect()]  # at most one per bucket
    manifests = _Manifests(spark, path)
    number, current = manifests.latest()
    for _ in range(attempts):
        version = f"{number + 1}-{uuid.uuid4().hex}"
        old = _versions(spark, path, {b: v for b, v in current.items() if b in touched}, results.schema)
        merged = upsert_latest(old.unionByName(fresh), ["session_id", "file_id"], "arrival")
        merged.withColumn("version", F.lit(version)).repartition("session_bucket").write.mode("append").partitionBy(
            "version", "session_bucket").parquet(f"{path}/data")
        based_on = {b: current.get(b) for b in touched}
        while {b: current.get(b) for b in touched} == based_on:
            if manifests.commit(number + 1, {**current, **dict.fromkeys(touched, version)}):
                return number + 1
            number, current = manifests.latest()
    raise ConflictError(f"{attempts} other writes changed the same buckets of {path}")


def vacuum_results(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete versions that none of the last `keep` manifests names; returns how many folders went. For a table without running writers."""
    manifests = _Manifests(spark, path)
    number, _ = manifests.latest()
    named = {(v, b) for n in range(max(number - keep + 1, 0), number + 1) for b, v in manifests.read(n).items()}
    gone = 0
    for status in manifests.fs.globStatus(manifests.jvm.org.apache.hadoop.fs.Path(f"{path}/data/version=*/session_bucket=*")):
        folder = status.getPath()
        if (folder.getParent().getName().split("=")[1], int(folder.getName().split("=")[1])) not in named:
            manifests.fs.delete(folder, True)
            gone += 1
    return gone


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, format: str = "parquet") -> None:
    """Nodes and edges as two tables under one path, as parquet or JSON."""
    nodes.write.mode("overwrite").format(format).save(f"{path}/nodes")
    edges.write.mode("overwrite").format(format).save(f"{path}/edges")
