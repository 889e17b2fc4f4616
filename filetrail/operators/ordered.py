"""Ordered scans inside groups that may be huge.

A window partitioned by a group runs one group in one task. A group here may hold a third of all rows, and a third of them
may share one order value, so the scans below range-partition all rows on (group, order), number them, and cut the numbers into
blocks of at most `BLOCK_ROWS` rows. A block holds whole groups but for the first and the last one, so what a block must know of
the blocks around it is one value: the fold over the rows of its first (or last) group there. That takes one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filetrail.session import stage

BLOCK_ROWS = 1 << 18
_PLACE, _BLOCK, _VALUE = "__place", "__block", "__value"


def in_blocks(df: DataFrame, keys: list[str], order: list[Column], rows: int = BLOCK_ROWS) -> DataFrame:
    """`df` staged with `__place`, rising along (keys, order), and `__block`, the number of its run of at most `rows` places.

    Range bounds come from a sample of `df`, so a `df` that is costly after its last shuffle should be a table. Equal order values
    may fall into different blocks; nothing depends on how values are spread.
    """
    along = [*map(F.col, keys), *order]
    placed = df.repartitionByRange(*along).sortWithinPartitions(*along).withColumn(_PLACE, F.monotonically_increasing_id())
    return stage(placed.withColumn(_BLOCK, F.expr(f"{_PLACE} div {rows}")), "ordered")


def _carried(rows: DataFrame, group: Column, fold, reverse: bool) -> DataFrame:
    """(block, group, carried): the fold over a block's first group (the last one with `reverse`) in the blocks before it (after it).

    One row per block and side takes part, and only those of one group meet.
    """
    edges = rows.groupBy(_BLOCK).agg(F.min_by(group, _PLACE).alias("first"), F.max_by(group, _PLACE).alias("last"))
    gives, takes = ("first", "last") if reverse else ("last", "first")
    totals = rows.join(edges, _BLOCK).filter(group.eqNullSafe(F.col(gives))).groupBy(_BLOCK).agg(
        F.first(gives).alias("group"), fold(_VALUE).alias("total"))
    asked = edges.select(_BLOCK, F.col(takes).alias("group"), F.lit(0).alias("gives"))
    both = asked.unionByName(totals.withColumn("gives", F.lit(1)), allowMissingColumns=True)
    along = F.col(_BLOCK).desc() if reverse else F.col(_BLOCK).asc()
    before = Window.partitionBy("group").orderBy(along, "gives").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("carried", fold("total").over(before)).filter("gives = 0 and carried is not null").select(
        F.col(_BLOCK), F.col("group").alias("__group"), F.col("carried").alias("__carried"))


def exclusive_prefix(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str, how: str = "max", reverse: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add `out`: the max, min or sum of `value` over the rows of the group strictly before this one.

    With `reverse` the rows after this one are used. Null keys are a group; rows that are equal in `order` come in some fixed order.
    No window holds more than `block_rows` rows of `df`.
    """
    fold = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    rows = in_blocks(df.withColumn(_VALUE, value), keys, order, block_rows)
    group = F.struct(*keys)
    place = F.col(_PLACE).desc() if reverse else F.col(_PLACE).asc()
    inside = Window.partitionBy(_BLOCK, *keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.repartition(_BLOCK).withColumn("__local", fold(_VALUE).over(inside))
    joined = local.join(_carried(rows, group, fold, reverse), _BLOCK, "left")
    carried = F.when(group.eqNullSafe(F.col("__group")), F.col("__carried"))
    if how == "sum":
        merged = F.coalesce(carried, F.lit(0)) + F.coalesce(F.col("__local"), F.lit(0))
    else:
        merged = {"max": F.greatest, "min": F.least}[how](carried, F.col("__local"))
    return joined.withColumn(out, merged).select(*df.columns, out)


def next_value(df: DataFrame, keys: list[str], order: str, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The next order value in the group, NULL on its last row."""
    return exclusive_prefix(df, keys, [F.col(order)], F.col(order), out, how="min", reverse=True, block_rows=block_rows)


def ordinal(df: DataFrame, keys: list[str], order: list[Column], out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Zero-based position of the row in its group."""
    return exclusive_prefix(df, keys, order, F.lit(1).cast("bigint"), out, how="sum", block_rows=block_rows)


def upsert_latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-replace: per key the row with the highest order value. Combines in the map task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(*keys, "row.*")


def first_last(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per key the first and the last value by order."""
    return df.groupBy(*keys).agg(
        F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value")
    )


def argmin_stable(df: DataFrame, keys: list[str], payload: list[str], measure: str, *ties: str) -> DataFrame:
    """Per key the row with the smallest measure; ties go to the smallest tie columns, in order."""
    rank = F.struct(measure, *ties)
    return df.groupBy(*keys).agg(F.min_by(F.struct(measure, *payload), rank).alias("best")).select(*keys, "best.*")


def argmax_stable(df: DataFrame, keys: list[str], payload: list[str], measure: str, *ties: str) -> DataFrame:
    """Per key the row with the largest measure; ties go to the smallest tie columns, in order."""
    rank = F.struct((-F.col(measure)).alias("m"), *ties)
    return df.groupBy(*keys).agg(F.min_by(F.struct(measure, *payload), rank).alias("best")).select(*keys, "best.*")
