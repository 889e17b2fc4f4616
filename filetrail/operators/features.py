"""Local-feature matching: two nearest descriptors in one other file, and the ratio test.

The ratio test needs the second-nearest distance inside each candidate file, so no descriptor can be ruled
out by a key. What keeps this affordable is that only files without a fingerprint parent ask, that copies of a
file are folded before files are paired, and that a session's files are spread over a grid of cells with a bounded
number of files per side. A cell compares its files in place; no pair becomes a row unless it survives the test.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filetrail.functions.binary import fixed_records
from filetrail.operators.ordered import BLOCK_ROWS, exclusive_prefix
from filetrail.session import stage

# Descriptor width in bytes, ratio of the test, matches needed.
DESCRIPTOR_BYTES = 32
RATIO = 0.75
MIN_GOOD = 25
# Files per side of a grid cell.
CELL_FILES = 256


def descriptors_to_rows(df: DataFrame, blob: str, stride: int = DESCRIPTOR_BYTES) -> DataFrame:
    """One row (kp, descriptor) per record of a descriptor blob; NULL and empty blobs give none."""
    others = [c for c in df.columns if c != blob]
    count = F.floor(F.octet_length(F.col(blob)) / stride)
    return df.select(
        *others, F.posexplode(fixed_records(F.col(blob), 0, count, stride)).alias("kp", "descriptor")
    )


def rows_to_blob(df: DataFrame, keys: list[str], blob: str = "blob") -> DataFrame:
    """Descriptor rows (kp, descriptor) of a file back into one blob, in kp order."""
    parts = F.sort_array(F.collect_list(F.struct("kp", "descriptor")))
    return df.groupBy(*keys).agg(
        F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["descriptor"])).alias(blob)
    )


def good_matches(asked: bytes, stored: bytes, stride: int, ratio: float) -> int:
    """Descriptors of the first blob whose nearest one in the second passes the ratio test."""
    a = np.frombuffer(asked, np.uint8).reshape(-1, stride)
    b = np.frombuffer(stored, np.uint8).reshape(-1, stride)
    if len(a) < 2 or len(b) < 2:
        return 0
    good = 0
    for start in range(0, len(a), 256):
        differing = np.bitwise_count(a[start:start + 256, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int32)
        nearest = np.partition(differing, 1, axis=1)
        good += int((nearest[:, 0] < ratio * nearest[:, 1]).sum())
    return good


def knn_ratio_match(
    features: DataFrame, uploads: DataFrame, asking: DataFrame | None = None, stride: int = DESCRIPTOR_BYTES,
    ratio: float = RATIO, min_good: int = 1, cell_files: int = CELL_FILES,
) -> DataFrame:
    """Pairs (session_id, file_id, parent_file_id, good) of files with at least `min_good` good matches.

    `features` is (session_id, file_id, blob); `uploads` gives arrivals; `asking` (session_id, arrival) limits
    the asking side. A pair is looked at only if some upload of the parent is older than some upload of the
    asking file.
    """
    spans = uploads.groupBy("session_id", "file_id").agg(
        F.min("arrival").alias("first_seen"), F.max("arrival").alias("last_seen")
    )
    stored = features.join(spans, ["session_id", "file_id"])
    if asking is None:
        asked = stored
    else:
        files = uploads.join(asking, ["session_id", "arrival"], "left_semi").select("session_id", "file_id")
        asked = stored.join(files, ["session_id", "file_id"], "left_semi")
    grids = spans.groupBy("session_id").agg(
        F.ceil(F.count(F.lit(1)) / cell_files).cast("int").alias("side")
    )

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        cell = F.pmod(F.xxhash64("file_id"), F.col("side")).cast("int")
        return df.join(grids, "session_id").select(
            "*", cell.alias(own), F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias(other)
        ).drop("side")

    cell = ["session_id", "row", "column"]
    left = placed(asked, "row", "column").select(*cell, "file_id", "last_seen", "blob")
    right = placed(stored, "column", "row").select(*cell, "file_id", "first_seen", "blob")
    right = right.toDF(*right.columns)  # new column identities, as both sides come from one table

    def compare(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found = [
            (a.session_id, a.file_id, b.file_id, good)
            for a in mine.itertuples() for b in others.itertuples()
            if b.first_seen < a.last_seen and (good := good_matches(a.blob, b.blob, stride, ratio)) >= min_good
        ]
        return pd.DataFrame(found, columns=["session_id", "file_id", "parent_file_id", "good"])

    kind = {f.name: f.dataType.simpleString() for f in features.schema}
    schema = (f"session_id {kind['session_id']}, file_id {kind['file_id']}, "
              f"parent_file_id {kind['file_id']}, good int")
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(compare, schema)


def local_feature_match(
    features: DataFrame, uploads: DataFrame, asking: DataFrame | None = None, min_good: int = MIN_GOOD,
    stride: int = DESCRIPTOR_BYTES, ratio: float = RATIO, block_rows: int = BLOCK_ROWS,
    cell_files: int = CELL_FILES,
) -> DataFrame:
    """Best feature parent per upload, in the shape of the fingerprint matches.

    Most good matches win; ties go to the candidate uploaded first. A candidate's order is its latest upload
    before the asking one.
    """
    pairs = stage(knn_ratio_match(features, uploads, asking, stride, ratio, min_good, cell_files), "feature-pairs")
    moments = uploads.select("session_id", "arrival", "file_id")
    if asking is not None:
        moments = moments.join(asking, ["session_id", "arrival"], "left_semi")
    moments = moments.join(pairs, ["session_id", "file_id"]).select(
        "session_id", "arrival", "parent_file_id", "good", F.lit(0).alias("step")
    )
    steps = uploads.select(
        "session_id", "arrival", F.col("file_id").alias("parent_file_id"), F.col("arrival").alias("order"),
        F.lit(1).alias("step"),
    ).join(pairs.select("session_id", "parent_file_id").distinct(), ["session_id", "parent_file_id"], "left_semi")
    together = moments.unionByName(steps, allowMissingColumns=True)
    seen = exclusive_prefix(
        together, ["session_id", "parent_file_id"],
        [F.col("arrival"), F.col("step")], F.col("order"), "parent_order", block_rows=block_rows,
    ).filter("step = 0 and parent_order is not null")
    choice = F.struct((-F.col("good")).alias("bad"), F.col("parent_order").alias("order"), "parent_file_id")
    best = seen.groupBy("session_id", "arrival").agg(F.min(choice).alias("best"))
    return best.select(
        "session_id", "arrival",
        F.col("best.parent_file_id").alias("parent_file_id"),
        F.col("best.order").alias("parent_order"),
        (-F.col("best.bad")).cast("int").alias("metric"),
        F.lit("orb_features").alias("match_type"),
    )
