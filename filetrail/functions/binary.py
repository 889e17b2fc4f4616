"""Integers and records out of binary columns, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it many times in `body`, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def piece(data: Column, at: Column | int, size: Column | int) -> Column:
    """`size` bytes from the zero-based offset `at`; shorter at the end of the data, NULL for a NULL offset or size.

    Offsets and sizes come out of files and may be anything, so they are held to the data before they become
    32-bit positions.
    """
    return F.substring(data, _held(at, data, 1), _held(size, data, 0))


def _held(value: Column | int, data: Column, more: int) -> Column:
    if isinstance(value, int):
        return F.lit(value + more)
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.octet_length(data)), F.lit(0)) + more).cast("int")


def number(data: Column, at: Column | int, size: int) -> Column:
    """Unsigned big-endian integer of 1 to 4 bytes; NULL past the end."""
    return F.conv(F.hex(piece(data, at, size)), 16, 10).cast("bigint")


def number_le(data: Column, at: Column | int, size: int) -> Column:
    """Unsigned little-endian integer of 1 to 4 bytes; NULL past the end."""
    digits = F.hex(piece(data, at, size))
    swapped = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.conv(swapped, 16, 10).cast("bigint")


def number_in_order(data: Column, at: Column | int, size: int, little: Column) -> Column:
    """Unsigned integer in the byte order given by a boolean column."""
    return F.when(little, number_le(data, at, size)).otherwise(number(data, at, size))


def signed32(value: Column) -> Column:
    return F.when(value >= 2**31, value - 2**32).otherwise(value)


def indexes(count: Column) -> Column:
    """array(0, ..., count-1), empty for zero, negative or NULL counts."""
    return F.when(count > 0, F.sequence(F.lit(0), F.least(count - 1, F.lit(2**31 - 2)).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )


def fixed_records(data: Column, base: Column | int, count: Column, stride: int) -> Column:
    """array<binary> of up to `count` whole records of `stride` bytes from offset `base`.

    The data is read out of its row once, not once per record: a lambda that names a column copies the column's bytes each time.
    """
    base = F.lit(base) if isinstance(base, int) else base

    def records(whole: Column) -> Column:
        fitting = F.greatest(F.lit(0), F.floor((F.octet_length(whole) - base) / stride))
        return F.transform(indexes(F.least(count, fitting)), lambda i: piece(whole, base + i * stride, stride))

    return let(data, records)
