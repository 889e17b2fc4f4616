"""Whole files as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the upload limit in bytes.
MAX_BYTES = 25 * 2**20
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def scan_files(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(path, filename, modificationTime, length, content). Files over the limit come with NULL for content: their rows are
    kept, so that they can be rejected, and their bytes are never read. Pass None to read all. The source itself leaves
    out empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return limited(reader.load(path), max_bytes).withColumn("filename", F.substring_index("path", "/", -1))


def entry_name(root: str, path: Column) -> Column:
    """The file or folder directly under the scanned `root` in which a path lies; a table may be one file or a folder of parts."""
    inside = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root).strip("/")
    return F.substring_index(F.element_at(F.split(path, rf"/\Q{inside}\E/+", 2), -1), "/", 1)


def limited(files: DataFrame, max_bytes: int | None) -> DataFrame:
    """Files up to the limit with their bytes, and the larger ones as rows that do not select them."""
    if max_bytes is None:
        return files
    large = files.filter(F.col("length") > max_bytes).withColumn("content", F.lit(None).cast("binary"))
    return files.filter(F.col("length") <= max_bytes).unionByName(large)


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; files that do not decode are dropped."""
    return spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)


def scan_curated(files: DataFrame, manifest: DataFrame, name: str = "filename") -> DataFrame:
    """The manifest's files in its order (`seq`, `name`); names without a file are skipped."""
    return files.join(manifest, name).orderBy("seq")


def reject_reason(length: Column, max_bytes: int = MAX_BYTES, invalid: Column | None = None) -> Column:
    """`400` for an empty file, `413` above the limit, `422` if extraction failed, NULL for a good file."""
    reason = F.when(F.coalesce(length, F.lit(0)) == 0, "400").when(length > max_bytes, "413")
    return reason if invalid is None else reason.when(F.coalesce(invalid, F.lit(False)), "422")


def split_rejects(
    files: DataFrame, length: Column, max_bytes: int = MAX_BYTES, invalid: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): good files, and the others with their `reason`."""
    marked = files.withColumn("reason", reject_reason(length, max_bytes, invalid))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")
