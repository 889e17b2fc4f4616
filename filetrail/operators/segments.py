"""Bytes to rows: containers whose records name their own length.

The next record's place depends on this one, so one small walker per container runs on the executors and
turns a file into rows, batch by batch through Arrow. Everything after that is relational.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filetrail.functions.binary import fixed_records, indexes, number, piece

# One row per record, and per file one closing row with a NULL type that says how the walk ended.
RECORD = T.StructType([
    T.StructField("seg_no", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("trailing", T.LongType()),
    T.StructField("truncated", T.BooleanType()),
])

# Markers without a length, frame headers, start of scan, end of image.
STANDALONE = {0x01, *range(0xD0, 0xD9)}
FRAMES = ["FFC0", "FFC1", "FFC2", "FFC3", "FFC5", "FFC6", "FFC7", "FFC9", "FFCA", "FFCB", "FFCD", "FFCE", "FFCF"]
SCAN, END = 0xDA, 0xD9
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
BOX_LEAVES = ("cbor", "json", "bfdb")

# Rows are handed on in batches of at most about this size.
FLUSH_BYTES, FLUSH_ROWS = 16 << 20, 20_000

# Inside a scan, FF 00 is a stuffed byte, FF D0-D7 a restart and FF FF a fill; any other FF pair is a marker.
_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")

Row = tuple[str, int, int, bytes, int, "str | None"]


def jpeg_records(data: bytes) -> tuple[list[Row], int, bool]:
    """Marker segments up to the end of image: rows, bytes after it, and whether it was never reached."""
    rows: list[Row] = []
    size = len(data)
    at = 2 if size >= 4 and data[:2] == b"\xff\xd8" else size
    while at < size - 1 and data[at] == 0xFF:
        code_at = at + 1
        while code_at < size and data[code_at] == 0xFF:
            code_at += 1
        if code_at == size:
            break
        code = data[code_at]
        if code == END:
            return rows, size - code_at - 1, False
        if code in STANDALONE:
            at = code_at + 1
            continue
        body = code_at + 3
        length = int.from_bytes(data[code_at + 1:body], "big")
        stop = code_at + 1 + length
        if body > size or stop > size:
            break
        rows.append((f"FF{code:02X}", at, length, data[body:stop], 0, None))
        at = stop
        if code == SCAN:
            marker = _NEXT_MARKER.search(data, stop)
            at = marker.start() if marker else size
    return rows, 0, True


def png_records(data: bytes) -> tuple[list[Row], int, bool]:
    """Chunks up to IEND. Check sums are not checked."""
    rows: list[Row] = []
    size = len(data)
    at = 8 if data[:8] == PNG_MAGIC else size
    while at + 8 <= size:
        length = int.from_bytes(data[at:at + 4], "big")
        kind = data[at + 4:at + 8].decode("ascii", "replace")
        stop = at + 8 + length
        if stop + 4 > size:
            break
        rows.append((kind, at, length, data[at + 8:stop], 0, None))
        at = stop + 4
        if kind == "IEND":
            return rows, size - at, False
    return rows, 0, True


def _boxes_between(data: bytes, at: int, size: int) -> list[tuple[str, int, int, int]]:
    """Boxes of one level between two offsets: kind, start, start and end of the body."""
    found = []
    while at + 8 <= size:
        length = int.from_bytes(data[at:at + 4], "big")
        head = 8
        if length == 1:
            if at + 16 > size:
                break
            head, length = 16, int.from_bytes(data[at + 8:at + 16], "big")
            if length < head:
                break
        stop = size if length == 0 else min(at + length, size)
        found.append((data[at + 4:at + 8].decode("ascii", "replace"), at, at + head, max(stop, at + head)))
        at = stop
        if length == 0:
            break
    return found


def _own_label(data: bytes, kids: list[tuple[str, int, int, int]]) -> str | None:
    """Label of a superbox: in its first description box, if bit 0 of the toggles says there is one."""
    for kind, _, start, stop in kids:
        if kind == "jumd":
            end = data.find(b"\x00", start + 17, stop)
            labelled = stop - start >= 17 and data[start + 16] & 1 and end != -1
            return data[start + 17:end].decode("utf-8", "replace") if labelled else None
    return None


def box_records(data: bytes) -> tuple[list[Row], int, bool]:
    """Nested boxes in reading order, to any depth. A superbox carries its own label, any other box its parent's."""
    rows: list[Row] = []
    # Boxes still to be visited, the next one last; offsets count from the parent's first byte, as a reader would say them.
    todo = [(*box, 0, 0, None) for box in reversed(_boxes_between(data, 0, len(data)))]
    while todo:
        kind, at, start, stop, depth, base, parent = todo.pop()
        if kind != "jumb":
            rows.append((kind, at - base, stop - start, data[start:stop], depth, parent))
            continue
        kids = _boxes_between(data, start, stop)
        label = _own_label(data, kids)
        rows.append((kind, at - base, stop - start, b"", depth, label))
        todo += [(*box, depth + 1, base + start - at, label) for box in reversed(kids)]
    return rows, 0, False


def any_records(data: bytes) -> tuple[list[Row], int, bool]:
    """The records of a JPEG or PNG by its magic bytes; none for other files, which have nothing trailing either."""
    if data[:3] == b"\xff\xd8\xff":
        return jpeg_records(data)
    return png_records(data) if data[:8] == PNG_MAGIC else ([], 0, False)


LAYOUTS = {"jpeg": jpeg_records, "png": png_records, "box": box_records, "any": any_records}


def explode_chained(
    df: DataFrame, keys: list[str], data: str, layout: str, carry: list[str] | None = None, once: list[str] = (),
) -> DataFrame:
    """One row per record of a chained layout, plus one closing row per file.

    `carry` lists the record types whose payload is wanted; others keep their length but not their bytes. Columns in
    `once` are passed through on the closing row only, so that one scan of the files yields everything about them.
    """
    walk = LAYOUTS[layout]
    wanted = None if carry is None else set(carry)
    passed = [*keys, *once]
    source = df.select(*passed, data)
    schema = T.StructType([T.StructField(k, source.schema[k].dataType) for k in passed] + RECORD.fields)
    tail = pa.schema([
        ("seg_no", pa.int32()), ("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
        ("payload", pa.binary()), ("depth", pa.int32()), ("label", pa.string()), ("trailing", pa.int64()),
        ("truncated", pa.bool_()),
    ])

    def flush(batch: pa.RecordBatch, rows: list[tuple], owners: list[int], closers: list[int | None]) -> pa.RecordBatch:
        everywhere, at_close = pa.array(owners, pa.int32()), pa.array(closers, pa.int32())
        columns = [batch.column(k).take(everywhere if k < len(keys) else at_close) for k in range(len(passed))]
        columns += [pa.array(c, f.type) for c, f in zip(zip(*rows), tail)]
        return pa.RecordBatch.from_arrays(columns, names=[*passed, *tail.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owners, closers, held = [], [], [], 0
            for i, content in enumerate(batch.column(len(passed))):
                records, trailing, truncated = walk(content.as_py() or b"")
                for n, (kind, at, length, body, depth, label) in enumerate(records):
                    kept = body if wanted is None or kind in wanted else None
                    held += len(kept or b"")
                    rows.append((n, kind, at, length, kept, depth, label, None, None))
                rows.append((len(records), None, None, None, None, None, None, trailing, truncated))
                owners += [i] * (len(records) + 1)
                closers += [None] * len(records) + [i]
                if held > FLUSH_BYTES or len(rows) > FLUSH_ROWS:
                    yield flush(batch, rows, owners, closers)
                    rows, owners, closers, held = [], [], [], 0
            if rows:
                yield flush(batch, rows, owners, closers)

    return source.mapInArrow(run, schema)


NESTED = "array<struct<seg_no:int,type:string,payload:binary>>"


def nest_chained(df: DataFrame, keys: list[str], data: str, layout: str, carry: list[str], once: list[str] = ()) -> DataFrame:
    """One row per file: keys, `once`, `records` (those of the types in `carry`, in file order), trailing, truncated.

    The rows keep the partitioning and order of the files, so nothing is shuffled to bring a file's records together again.
    """
    walk, wanted, passed = LAYOUTS[layout], set(carry), [*keys, *once]
    source = df.select(*passed, data)
    kinds = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in passed)

    def flush(batch: pa.RecordBatch, start: int, ends: list[int], rows: list[tuple], closing: list[tuple[int, bool]]) -> pa.RecordBatch:
        n = len(closing)
        fields = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.binary()))]
        records = pa.ListArray.from_arrays(
            pa.array([0, *ends], pa.int32()), pa.StructArray.from_arrays(fields, names=["seg_no", "type", "payload"]))
        columns = [batch.column(k).slice(start, n) for k in range(len(passed))]
        return pa.RecordBatch.from_arrays(
            [*columns, records, pa.array([c[0] for c in closing], pa.int64()), pa.array([c[1] for c in closing], pa.bool_())],
            names=[*passed, "records", "trailing", "truncated"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, ends, rows, closing, held = 0, [], [], [], 0
            for i, content in enumerate(batch.column(len(passed))):
                records, trailing, truncated = walk(content.as_py() or b"")
                mine = [(n, r[0], r[3]) for n, r in enumerate(records) if r[0] in wanted]
                rows += mine
                held += sum(len(r[2]) for r in mine)
                ends.append(len(rows))
                closing.append((trailing, truncated))
                if held > FLUSH_BYTES or len(rows) > FLUSH_ROWS:
                    yield flush(batch, start, ends, rows, closing)
                    start, ends, rows, closing, held = i + 1, [], [], [], 0
            if closing:
                yield flush(batch, start, ends, rows, closing)

    return source.mapInArrow(run, f"{kinds}, records {NESTED}, trailing bigint, truncated boolean")


def explode_jpeg_segments(files: DataFrame, keys: list[str], data: str = "content", carry=None) -> DataFrame:
    return explode_chained(files, keys, data, "jpeg", carry)


def explode_png_chunks(files: DataFrame, keys: list[str], data: str = "content", carry=None) -> DataFrame:
    return explode_chained(files, keys, data, "png", carry)


def explode_boxes(streams: DataFrame, keys: list[str], data: str = "stream") -> DataFrame:
    return explode_chained(streams, keys, data, "box").filter("type is not null")


def trailing_bytes(records: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes after the terminator (0 if it was never reached) and the truncation flag, one row per file."""
    return records.filter("type is null").select(*keys, F.col("trailing").alias("trailing_bytes"), "truncated")


def frame_header(payload: Column) -> Column:
    """struct<width, height, components, sampling> of a frame header; NULLs if it is too short."""
    whole = F.octet_length(payload) >= 6
    listed = fixed_records(payload, 6, number(payload, 5, 1), 3)
    # A component entry counts as soon as its id and sampling byte are there.
    cut = F.octet_length(payload) - (6 + F.size(listed) * 3) == 2
    short = F.when(cut & (F.size(listed) < number(payload, 5, 1)), F.array(piece(payload, 6 + F.size(listed) * 3, 2)))
    entries = F.concat(listed, F.coalesce(short, F.array().cast("array<binary>")))
    sampling = F.transform(
        entries,
        lambda e: F.struct(
            number(e, 0, 1).cast("int").alias("id"),
            F.shiftright(number(e, 1, 1), 4).cast("int").alias("h"),
            number(e, 1, 1).bitwiseAND(F.lit(15)).cast("int").alias("v"),
        ),
    )
    return F.struct(
        F.when(whole, number(payload, 3, 2)).alias("width"),
        F.when(whole, number(payload, 1, 2)).alias("height"),
        F.when(whole, number(payload, 5, 1).cast("int")).alias("components"),
        F.when(whole, sampling).alias("sampling"),
    )


def image_dims(records: DataFrame, keys: list[str]) -> DataFrame:
    """Size of a JPEG (its last whole frame header) or PNG (IHDR), from the container's records."""
    jpeg = F.col("type").isin(FRAMES) & (F.octet_length("payload") >= 6)
    png = (F.col("type") == "IHDR") & (F.octet_length("payload") >= 8)
    p = F.col("payload")
    size = F.when(png, F.struct(number(p, 0, 4).alias("width"), number(p, 4, 4).alias("height"))).otherwise(
        F.struct(number(p, 3, 2).alias("width"), number(p, 1, 2).alias("height"))
    )
    return (
        records.filter(jpeg | png).groupBy(*keys)
        .agg(F.max_by(size, F.col("seg_no")).alias("size")).select(*keys, "size.width", "size.height")
    )


def tables_in(data: Column) -> Column:
    """array<struct<table_id, values>> of the whole tables of a table segment, in order.

    A table takes 65 bytes, or 129 where the precision nibble is set. The running start of each table comes from a fold over the
    segment, so nothing but the segment's own bytes is needed.
    """
    span = lambda at: F.when(number(data, at, 1) >= 16, 129).otherwise(65)
    most = F.ceil(F.octet_length(data) / 65).cast("int")
    starts = F.aggregate(
        indexes(most),
        F.array(F.lit(0)),
        lambda acc, _: F.when(
            F.element_at(acc, -1) < F.octet_length(data),
            F.concat(acc, F.array((F.element_at(acc, -1) + span(F.element_at(acc, -1))).cast("int"))),
        ).otherwise(acc),
    )
    whole = F.filter(starts, lambda at: (at < F.octet_length(data)) & (at + span(at) <= F.octet_length(data)))

    def table(at: Column) -> Column:
        head = number(data, at, 1)
        values = F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda k: F.when(head >= 16, number(data, at + 1 + 2 * k, 2)).otherwise(number(data, at + 1 + k, 1)))
        return F.struct((head % 16).cast("int").alias("table_id"), values.alias("values"))

    return F.transform(whole, table)


def quant_tables(records: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, table_id, values): the last quantization table of each id in a file."""
    read = records.filter("type = 'FFDB'").select(*keys, "seg_no", F.posexplode(tables_in(F.col("payload"))).alias("pos", "t"))
    return read.groupBy(*keys, F.col("t.table_id").alias("table_id")).agg(
        F.max_by("t.values", F.struct("seg_no", "pos")).alias("values"))


def chroma_subsampling(sampling: Column) -> Column:
    """Ratio name from the sampling factors of the two lowest component ids; the last entry of an id counts."""
    ids = F.array_sort(F.array_distinct(F.transform(sampling, lambda c: c["id"])))

    def factor(k: int) -> Column:
        return F.element_at(F.filter(sampling, lambda c: c["id"] == F.get(ids, k)), -1)

    luma, chroma = factor(0), factor(1)
    tag = lambda c: F.concat(F.lit("("), c["h"].cast("string"), F.lit(", "), c["v"].cast("string"), F.lit(")"))
    plain = (chroma["h"] == 1) & (chroma["v"] == 1)
    two = (
        F.when((luma["h"] == 2) & (luma["v"] == 2) & plain, "4:2:0")
        .when((luma["h"] == 2) & (luma["v"] == 1) & plain, "4:2:2")
        .when((luma["h"] == 1) & (luma["v"] == 2) & plain, "4:4:0")
        .when((luma["h"] == chroma["h"]) & (luma["v"] == chroma["v"]), "4:4:4")
        .otherwise(F.concat(F.lit("custom("), tag(luma), F.lit("/"), tag(chroma), F.lit(")")))
    )
    return F.when(F.size(ids) >= 2, two).when(F.size(ids) == 1, "4:4:4")


def encoder_fingerprint(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per JPEG: both tables, whether they are identical, progressive flag, subsampling."""
    tables = quant_tables(records, keys).groupBy(*keys).agg(
        F.max(F.when(F.col("table_id") == 0, F.col("values"))).alias("quant_luma"),
        F.max(F.when(F.col("table_id") == 1, F.col("values"))).alias("quant_chroma"),
    )
    frames = records.filter(F.col("type").isin(FRAMES))
    header = frame_header(F.col("payload"))
    frames = frames.select(*keys, "seg_no", "type", header["sampling"].alias("sampling")).groupBy(*keys).agg(
        (F.max_by("type", "seg_no") == "FFC2").alias("progressive"),
        F.flatten(F.transform(
            F.array_sort(F.collect_list(F.when(
                F.col("sampling").isNotNull(), F.struct("seg_no", "sampling")))), lambda f: f["sampling"],
        )).alias("sampling"),
    )
    files = records.filter("type is null").select(*keys)
    joined = files.join(tables, keys, "left").join(frames, keys, "left")
    return joined.select(
        *keys, "quant_luma", "quant_chroma",
        F.coalesce(F.col("quant_luma") == F.col("quant_chroma"), F.lit(False)).alias("quant_identical"),
        F.coalesce("progressive", F.lit(False)).alias("progressive"),
        chroma_subsampling(F.col("sampling")).alias("chroma_subsampling"),
    )


def reassemble_parts(parts: DataFrame, keys: list[str], payload: str, *order: str, out: str = "whole") -> DataFrame:
    """Concatenate the parts of a split payload, in order. Completeness is not checked."""
    lined_up = F.sort_array(F.collect_list(F.struct(*order, payload)))
    empty = F.lit("") if parts.schema[payload].dataType == T.StringType() else F.lit(b"")
    return parts.groupBy(*keys).agg(F.aggregate(lined_up, empty, lambda acc, p: F.concat(acc, p[payload])).alias(out))


# An inflated profile may be this large; profiles are a few kilobytes, and a small file can claim terabytes.
MAX_INFLATED = 16 << 20


@F.pandas_udf(T.BinaryType())
def inflate(packed: pd.Series) -> pd.Series:
    """zlib data, or NULL if it does not inflate within `MAX_INFLATED` bytes."""
    def opened(data):
        if data is None:
            return None
        stream = zlib.decompressobj()
        try:
            out = stream.decompress(data, MAX_INFLATED)
        except zlib.error:
            return None
        return out if stream.eof else None

    return packed.map(opened, na_action="ignore")
