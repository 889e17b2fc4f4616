"""Token ids in record files: length, masked checksum, data, masked checksum; with an offset index for reads in any order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filetrail.llm import common, crc32c
from filetrail.llm.tokens import Encoder, vocabulary_path
from filetrail.session import staging_dir

HEAD, TAIL = 12, 4  # bytes around the data of one record
READ_BYTES = 8 << 20
INDEX = "part int, record long, doc_id long, file string, offset long, length long, part_start long, n_tokens long, id_bytes int"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def framed(data: list[bytes]) -> bytes:
    """Records one after another. Checksums are CRC-32C, of the eight bytes of the length and of the data."""
    lengths = np.array([len(d) for d in data], np.int64)
    heads = lengths.astype("<u8").tobytes()
    n = len(data)
    of_length = crc32c.masked(crc32c.crc32c(np.frombuffer(heads, np.uint8), np.arange(n) * 8, np.full(n, 8)))
    raw = np.frombuffer(b"".join(data), np.uint8)
    of_data = crc32c.masked(crc32c.crc32c(raw, np.cumsum(lengths) - lengths, lengths))
    head_crc, data_crc = of_length.astype("<u4").tobytes(), of_data.astype("<u4").tobytes()
    return b"".join(
        part for i, d in enumerate(data)
        for part in (heads[8 * i:8 * i + 8], head_crc[4 * i:4 * i + 4], d, data_crc[4 * i:4 * i + 4]))


def unframed(block: bytes, offsets: np.ndarray) -> list[bytes]:
    """The data of the records that start at `offsets` of `block`; raises where a checksum is wrong."""
    if not len(offsets):
        return []
    raw = np.frombuffer(block, np.uint8)
    heads = raw[offsets[:, None] + np.arange(HEAD)]
    lengths = np.ascontiguousarray(heads[:, :8]).view("<u8")[:, 0].astype(np.int64)
    if not (crc32c.masked(crc32c.crc32c(raw, offsets, np.full(len(offsets), 8)))
            == np.ascontiguousarray(heads[:, 8:]).view("<u4")[:, 0]).all():
        raise ValueError("a record's length does not match its checksum")
    ends = offsets + HEAD + lengths
    said = np.ascontiguousarray(raw[ends[:, None] + np.arange(TAIL)]).view("<u4")[:, 0]
    if not (crc32c.masked(crc32c.crc32c(raw, offsets + HEAD, lengths)) == said).all():
        raise ValueError("a record's data does not match its checksum")
    return [block[a:b] for a, b in zip((offsets + HEAD).tolist(), ends.tolist(), strict=True)]


def write_records(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode every whole text, append `end_id`, write record files in ascending doc_id order; return the offset index.

    One file per range of doc_id under `folder` (a new one in the shared folder by default), named by partition and task
    attempt, so a repeated task writes a file of its own and the index names the one that counts. Ids are 16 bits wide where
    the vocabulary allows, else 32 (`id_bytes`). The index is a staged table, one row per document in file order:
    part, record, doc_id, file, offset, length, part_start (ids before it in its file), n_tokens (with the end id), id_bytes.
    Null texts are empty (one id, the end); null doc_ids come first; rows with equal doc_id are ordered by their text's hash;
    an empty table gives an empty index. Other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path()
    folder = folder or f"{staging_dir(spark)}/filetrail/records-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    parts = common.parts_for(spark, common.text_bytes(rows))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.of(path), TaskContext.get()
        end = np.array([end_id], encoder.dtype).tobytes()
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.rec"
        offset = start = record = 0
        with files.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                data = [ids + end for ids in encoder.encode(common.texts_of(batch.column("text")))]
                out.write(framed(data))
                n = len(data)
                lengths = np.array([len(d) for d in data], np.int64)
                counts = lengths // encoder.dtype.itemsize
                frames = lengths + HEAD + TAIL
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, task.partitionId(), np.int32)), pa.array(record + np.arange(n)),
                    batch.column("doc_id"), pa.array([f"{folder}/{name}"] * n, pa.string()),
                    pa.array(offset + np.cumsum(frames) - frames), pa.array(lengths),
                    pa.array(start + np.cumsum(counts) - counts), pa.array(counts),
                    pa.array(np.full(n, encoder.dtype.itemsize, np.int32)),
                ], names=[c.split()[0] for c in INDEX.split(", ")])
                offset, start, record = offset + int(frames.sum()), start + int(counts.sum()), record + n

    return common.stage(ordered.mapInArrow(common.lean(write, "encoders"), INDEX), "record-index")


def with_starts(index: DataFrame) -> DataFrame:
    """Add `start`, the ids of all documents before this one. What meets on the driver is one number per file."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    begin, rows = 0, []
    for row in totals:
        rows.append((row["part"], begin))
        begin += row["n"]
    offsets = index.sparkSession.createDataFrame(rows, "part int, before long")
    return index.join(offsets, "part").withColumn("start", F.col("before") + F.col("part_start")).drop("before")


def read_records(index: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Read the records that index rows name, in any order and any subset, and verify their checksums.

    Returns doc_id, start (if the index has it, else part_start), n_tokens, ids_crc32 (of the ids as little-endian unsigned
    32-bit integers), and with `keep_ids` the ids as such bytes. Neighbouring records are read in one go, a few MB at a time.
    """
    start = "start" if "start" in index.columns else "part_start"
    columns = index.select("doc_id", F.col(start).alias("start"), "n_tokens", "file", "offset", "length", "id_bytes")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("file").to_pylist(), object)
            offsets, lengths = batch.column("offset").to_numpy(), batch.column("length").to_numpy()
            widths = batch.column("id_bytes").to_numpy()
            crcs, ids = np.zeros(len(names), np.int64), [None] * len(names)
            for name in dict.fromkeys(names):
                rows = np.flatnonzero(names == name)
                rows = rows[np.argsort(offsets[rows])]
                files, root = _filesystem(name)
                with files.open_input_file(root) as source:
                    for run in _runs(rows, offsets, lengths):
                        first = offsets[run[0]]
                        block = source.read_at(int(offsets[run[-1]] + lengths[run[-1]] + HEAD + TAIL - first), int(first))
                        for i, data in zip(run, unframed(block, offsets[run] - first), strict=True):
                            wide = np.frombuffer(data, f"<u{widths[i]}").astype("<u4")
                            if len(data) != lengths[i]:
                                raise ValueError("the index and a record disagree")
                            crcs[i] = common.crc_u32(wide)
                            ids[i] = wide.tobytes() if keep_ids else None
            out = [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crcs)]
            yield pa.RecordBatch.from_arrays(
                out + [pa.array(ids, pa.binary())] * keep_ids, names=[c.split()[0] for c in schema.split(", ")])

    return columns.mapInArrow(common.lean(read), schema)


def _runs(rows: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Cut rows, in offset order, where a gap follows or a block would exceed `READ_BYTES`."""
    start = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or (
            offsets[rows[i]] != offsets[rows[i - 1]] + lengths[rows[i - 1]] + HEAD + TAIL
            or offsets[rows[i]] - offsets[rows[start]] > READ_BYTES
        ):
            yield rows[start:i]
            start = i
