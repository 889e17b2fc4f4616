"""Content hashes, 64-bit fingerprints and their distance."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from filetrail.functions.binary import let


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def file_id(sha256: Column) -> Column:
    """The identity of a file in its session: the first 16 hex digits of its content hash."""
    return F.substring(sha256, 1, 16)


def hash_bits(hex_hash: Column) -> Column:
    """16 hex digits as a bigint (two's complement); NULL for NULL or empty text."""
    return F.conv(F.nullif(hex_hash, F.lit("")), 16, -10).cast("bigint")


def hash_hex(bits: Column, digits: int = 16) -> Column:
    return F.lpad(F.lower(F.hex(bits)), digits, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Distance in bits between two hex hashes of up to 64 bits."""
    return hamming(hash_bits(a), hash_bits(b))


def pack_bits(bits: Column) -> Column:
    """array<boolean> of up to 64 entries, first entry highest, as a bigint."""
    return F.aggregate(
        bits, F.lit(0).cast("bigint"),
        lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(F.when(bit, 1).otherwise(0).cast("bigint")),
    )


def bits_to_hex(bits: Column, count: int) -> Column:
    return hash_hex(pack_bits(bits), (count + 3) // 4)


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return total / F.size(values)


def array_median(values: Column) -> Column:
    """Median with the two middle values averaged for even sizes."""
    n = F.size(values)
    low = F.floor((n - 1) / 2).cast("int")
    high = F.floor(n / 2).cast("int")
    return let(F.array_sort(values), lambda ordered: (F.get(ordered, low) + F.get(ordered, high)) / 2)


def luma(red: Column, green: Column, blue: Column) -> Column:
    """ITU-R 601 gray level in 16-bit fixed point, rounded; channels are integers from 0 to 255."""
    return F.shiftright(red * 19595 + green * 38470 + blue * 7471 + 32768, 16)


def ahash(grid: Column, cells: int) -> Column:
    """Average hash: a bit per cell, set above the mean."""
    return let(array_mean(grid), lambda mean: bits_to_hex(F.transform(grid, lambda v: v > mean), cells))


def above_median(values: Column, cells: int) -> Column:
    """Hex of a bit per value, set above the median of the values."""
    return let(
        values,
        lambda vs: let(
            array_median(vs), lambda middle: bits_to_hex(F.transform(vs, lambda v: v > middle), cells)
        ),
    )


def dhash(grid: Column, rows: int, cols: int) -> Column:
    """Gradient hash of a row-major grid: a bit per neighbouring pair in a row, set when it rises."""
    rises = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(rows - 1)),
            lambda y: F.zip_with(
                F.slice(grid, y * cols + 2, F.lit(cols - 1)),
                F.slice(grid, y * cols + 1, F.lit(cols - 1)),
                lambda right, left: right > left,
            ),
        )
    )
    return bits_to_hex(rises, rows * (cols - 1))


def _cosine_basis(size: int, keep: int) -> list[list[float]]:
    """The first `keep` rows of the type-II cosine basis (scale 2) for `size` samples."""
    return [
        [2.0 * math.cos(math.pi * u * (2 * x + 1) / (2 * size)) for x in range(size)] for u in range(keep)
    ]


def cosine_coefficients(grid: Column, size: int, keep: int = 8) -> Column:
    """The `keep` x `keep` lowest two-dimensional cosine coefficients of a square row-major grid."""
    basis = F.array(*[F.array(*[F.lit(v) for v in row]) for row in _cosine_basis(size, keep)])
    position = F.sequence(F.lit(0), F.lit(size - 1))

    def dot(xs: Column, ys: Column) -> Column:
        products = F.zip_with(xs, ys, lambda x, y: x * y)
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    columns = F.transform(
        position,
        lambda x: F.transform(position, lambda y: F.get(grid, y * size + x).cast("double")),
    )
    down = let(
        columns,
        lambda cs: F.transform(basis, lambda wave: F.transform(cs, lambda column: dot(column, wave))),
    )
    return F.flatten(
        F.transform(down, lambda line: F.transform(basis, lambda wave: dot(line, wave)))
    )


def phash(grid: Column, size: int, keep: int = 8) -> Column:
    """Frequency hash: a bit per low cosine coefficient, set above their median."""
    return above_median(cosine_coefficients(grid, size, keep), keep * keep)


def haar_low_band(grid: Column, size: int, keep: int) -> Column:
    """The low band of a two-dimensional Haar transform: averages of (size/keep)-wide square blocks."""
    step = size // keep
    return F.transform(
        F.sequence(F.lit(0), F.lit(keep * keep - 1)),
        lambda cell: array_mean(
            F.transform(
                F.sequence(F.lit(0), F.lit(step * step - 1)),
                lambda k: F.get(
                    grid,
                    ((F.floor(cell / keep) * step + F.floor(k / step)) * size
                     + (cell % keep) * step + k % step).cast("int"),
                ).cast("double"),
            )
        ),
    )


def whash(grid: Column, size: int, keep: int = 8) -> Column:
    """Wavelet hash: a bit per low-band cell, set above the band's median."""
    return above_median(haar_low_band(grid, size, keep), keep * keep)


def sorted_distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


# Shingles whose hashes are held at a time.
VOTES = 1 << 16


def vote(text: bytes, width: int) -> int | None:
    """Fingerprint of one text; None where it has fewer than `width` words."""
    words = text.split(b" ")
    grams = iter(set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))))
    tally, n = np.zeros(64, np.int64), 0
    while digests := b"".join([hashlib.md5(g).digest()[:8] for g in islice(grams, VOTES)]):
        hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
        tally += np.unpackbits(hashes, axis=1).sum(0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(tally * 2 > n).tobytes(), "big", signed=True) if n else None


def simhash64(df: DataFrame, key: list[str], text: str, width: int = 3, out: str = "simhash") -> DataFrame:
    """64-bit fingerprint of whole texts, as a bigint; NULL where a text has fewer than `width` words.

    `key` names the columns to keep. Every distinct shingle votes on every bit. A text's shingles are listed, hashed and counted
    where its row is, in Arrow batches, so none becomes a row of Spark and nothing is shuffled.
    """
    rows = df.select(*key, F.col(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(key))
            marks = [None if t is None else vote(t, width) for t in (x.as_py() for x in texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(key)], pa.array(marks, pa.int64())], names=[*key, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:len(key)], StructField(out, LongType())]))
