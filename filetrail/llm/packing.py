"""Concatenate and cut: all token ids in one line, cut into windows of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filetrail.llm import common
from filetrail.llm.tokens import Encoder, vocabulary_path

TOKENS = "part int, part_start long, doc_id long, doc_tokens long, id_bytes int, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "crosses boolean")


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """First pass, staged: ids of each whole text and `end_id`, and where they start among the ids of their partition."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype).tobytes()
        start = 0
        for batch in batches:
            data = [ids + end for ids in encoder.encode(common.texts_of(batch.column("text")))]
            counts = np.array([len(d) for d in data], np.int64) // encoder.dtype.itemsize
            n = len(data)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, part, np.int32)), pa.array(start + np.cumsum(counts) - counts), batch.column("doc_id"),
                pa.array(counts), pa.array(np.full(n, encoder.dtype.itemsize, np.int32)), pa.array(data, pa.binary()),
            ], names=[c.split()[0] for c in TOKENS.split(", ")])
            start += int(counts.sum())

    return common.stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.lean(run, "encoders"), TOKENS), "tokens")


def pack(docs: DataFrame, length: int = 2048, path: str | None = None, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence of `length` ids.

    Two passes. The first stages ids with running sums per partition; the totals per partition (one number each) meet on the
    driver and their prefix sums are the partitions' global offsets. The second cuts each document at multiples of `length` of
    its global offset. Nothing is shuffled, and only the last sequence can be short, so padding is at most one sequence.
    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, `crosses` (a boundary record: its
    sequence also holds ids of another partition) and with `keep_ids` the ids as little-endian unsigned 32-bit bytes.
    Null texts are empty: one piece with the end id. Repeated and null doc_ids are documents of their own. An empty table gives no
    piece. Other columns are ignored.
    """
    tokens = tokenize(docs, path, end_id)
    begin, offsets, totals = 0, {}, {}
    for row in tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect():
        offsets[row["part"]], totals[row["part"]] = begin, row["n"]
        begin += row["n"]
    schema = PIECES + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column("part").to_numpy()
            before = np.array([offsets[p] for p in parts.tolist()], np.int64)
            ends = np.array([offsets[p] + totals[p] for p in parts.tolist()], np.int64)
            counts = batch.column("doc_tokens").to_numpy()
            at = before + batch.column("part_start").to_numpy()
            windows = (at + counts - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(at)), windows)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            sequence = at[row] // length + nth
            left = np.maximum(at[row], sequence * length)
            right = np.minimum(at[row] + counts[row], (sequence + 1) * length)
            start, size = left - at[row], right - left
            ids = batch.column("ids").to_pylist()
            widths = batch.column("id_bytes").to_numpy()
            cut, wide, last = [], None, -1
            for i, a, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True):
                if i != last:
                    wide, last = np.frombuffer(ids[i], f"<u{widths[i]}").astype("<u4"), i
                cut.append(wide[a:a + n])
            crosses = (sequence * length < before[row]) | ((sequence + 1) * length > ends[row])
            out = [
                batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(size),
                pa.array([common.crc_u32(c) for c in cut], pa.int64()), pa.array(counts[row]), pa.array(sequence),
                pa.array(left - sequence * length), pa.array(crosses),
            ]
            if keep_ids:
                out.append(pa.array([c.tobytes() for c in cut], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])

    return tokens.mapInArrow(common.lean(run), schema)


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """Whole sequences from pieces with ids: sequence_id, n_ids, ids (bytes, padded to `length` unless a power of two long).

    Each sequence gathers at most `length` ids.
    """
    parts = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_ids"))
    joined = F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    missing = F.when(F.bit_count("n_ids") == 1, 0).otherwise(length - F.col("n_ids")).cast("int")
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), missing))
    return parts.select("sequence_id", "n_ids", F.concat(joined, pad).alias("ids"))
