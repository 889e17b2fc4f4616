"""Exact similarity joins on 64-bit fingerprints.

Two values within distance k agree closely on at least one band: cut 64 bits into m bands and allow band i
r_i differing bits, with sum(r_i) = k - m + 1. If every band exceeded its allowance, the distance would be at
least sum(r_i + 1) = k + 1. So an equi-join on (band, band value) loses no pair if the two sides together list every
value within the band's allowance (multi-index hashing: Norouzi, Punjani, Fleet, 2012). The sides meet half way: one
lists the values within half the allowance, the other those within the rest, which takes far fewer rows than listing
them all on one side. More listed keys buy more selective ones; the cheapest layout is picked per session from the
number of its distinct values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 64


@dataclass(frozen=True)
class Band:
    shift: int
    width: int
    allowance: int

    def reach(self, searched: bool) -> int:
        """Bits flipped on one side; the two sides add up to the allowance."""
        return self.allowance - self.allowance // 2 if searched else self.allowance // 2

    def keys(self, searched: bool) -> int:
        return sum(comb(self.width, r) for r in range(self.reach(searched) + 1))

    def masks(self, searched: bool) -> list[int]:
        """Every pattern of flipped bits in the band that one side lists."""
        return [
            sum(1 << b for b in bits)
            for r in range(self.reach(searched) + 1)
            for bits in combinations(range(self.width), r)
        ]


# All values of a group are candidates of each other, in a grid of cells.
WHOLE_GROUP = [Band(0, 0, 0)]
# Values of one side in a cell, on average.
CELL_VALUES = 1 << 14
# Shuffling a key and handing it to a worker costs about as much as comparing this many candidates.
KEY_WEIGHT = 512
# Keys of one side that a worker is handed together, on average, and candidates that it compares at a time.
BUCKET_KEYS, BLOCK_SEARCHED, BLOCK_STORED = 50_000, 256, 4096
# Layouts listing more keys than this per band would make the table of masks itself large; the others are exact too.
MAX_MASKS = 4096


def layout(radius: int, bands: int) -> list[Band]:
    """An exact layout of `bands` bands for a search radius."""
    spare = max(0, radius - bands + 1)
    made, shift = [], 0
    for i in range(bands):
        width = BITS // bands + (1 if i < BITS % bands else 0)
        allowance = spare // bands + (1 if i < spare % bands else 0)
        made.append(Band(shift, width, min(allowance, width)))
        shift += width
    return made


def cost(bands: list[Band], values: int) -> float:
    """Work per value: listed keys, which are shuffled, plus candidates, which cost one comparison each and whose
    number is that expected from evenly spread bands."""
    cells = -(-values // CELL_VALUES) if bands == WHOLE_GROUP else 1
    listed = cells * sum(b.keys(True) + b.keys(False) for b in bands)
    return KEY_WEIGHT * listed + values * sum(b.keys(True) * b.keys(False) / 2.0**b.width for b in bands)


def layout_steps(radius: int, choices: tuple[int, ...], largest: int = 1 << 40) -> list[tuple[int, list[Band]]]:
    """(number of values, layout) in rising order: the cheapest layout up to each session size.

    The last layout also serves every larger size, so it stays exact if `largest` is an estimate.
    """
    layouts = [WHOLE_GROUP] + [layout(radius, m) for m in choices if m <= radius + 1]
    layouts = [bands for bands in layouts if all(b.keys(True) <= MAX_MASKS for b in bands)]
    steps: list[tuple[int, list[Band]]] = []
    size = 1
    while not steps or steps[-1][0] < largest:
        best = min(layouts, key=lambda bands: cost(bands, size))
        if steps and steps[-1][1] == best:
            steps[-1] = (size, best)
        else:
            steps.append((size, best))
        size *= 2
    return steps


def band_table(spark: SparkSession, steps: list[tuple[int, list[Band]]], searched: bool) -> DataFrame:
    """(layout, band, shift, keep, mask): one row per key that a side lists for a value.

    Its size depends on the layouts only, never on the data: at most MAX_MASKS rows per band.
    """
    rows = [
        (tag, i, band.shift, (1 << band.width) - 1, mask)
        for tag, (_, bands) in enumerate(steps)
        for i, band in enumerate(bands)
        for mask in band.masks(searched)
    ]
    return spark.createDataFrame(rows, "layout int, band int, shift int, keep bigint, mask bigint")


def _keyed(rows: DataFrame, table: DataFrame, bits: str) -> DataFrame:
    value = F.expr(f"(shiftrightunsigned({bits}, shift) & keep) ^ mask")
    return rows.join(F.broadcast(table), "layout").withColumn("__key", value).drop("layout", "shift", "keep", "mask")


def _near(near: np.ndarray, first: np.ndarray | None, h: np.ndarray, moment: np.ndarray | None, least: int, most: int, best: bool
          ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(stored place, searched place, distance) of one cell's pairs, block by block; with `best` only the nearest of each searched value."""
    stored = np.arange(len(near)) if first is None else np.argsort(first, kind="stable")
    searched = np.arange(len(h)) if first is None else np.argsort(moment, kind="stable")
    near, h = near[stored], h[searched]
    for i in range(0, len(h), BLOCK_SEARCHED):
        part, found = h[i:i + BLOCK_SEARCHED, None], []
        # Values that come later than all of this block are not looked at.
        end = len(near) if first is None else int(np.searchsorted(first[stored], moment[searched[i:i + BLOCK_SEARCHED]].max(), side="left"))
        for j in range(0, end, BLOCK_STORED):
            distance = np.bitwise_count(part ^ near[None, j:min(end, j + BLOCK_STORED)])
            x, y = np.nonzero(distance <= most)
            far = distance[x, y]
            keep = far >= least
            if first is not None:
                keep &= first[stored[j + y]] < moment[searched[i + x]]
            found.append((stored[j + y[keep]], x[keep], far[keep]))
        if not found:
            continue
        y, x, far = (np.concatenate(c) for c in zip(*found, strict=True))
        if best:
            nearest = np.full(len(part), 255, np.uint8)
            np.minimum.at(nearest, x, far)
            y, x, far = (c[far == nearest[x]] for c in (y, x, far))
        if len(x):
            yield y, searched[i + x], far


def near_values(
    searched: DataFrame, stored: DataFrame, keys: list[str], radius: int,
    bits: str = "h", before: str | None = None, bands: int | None = None, at_least: int = 0,
    largest: int = 1 << 40, best: bool = False,
) -> DataFrame:
    """Pairs (searched row, stored row) of one group with at_least <= distance <= radius.

    Both sides carry `keys`, `bits` and any payload; stored payload columns must have other names. `before`
    names an order column: the stored side must have `first_<before>` < searched `<before>`. Both sides must
    hold distinct values per group, so copies never multiply. `bands` fixes one layout; by default it is
    chosen per group from the group's number of stored values; `largest`, the number of values of the largest
    group, only keeps layouts out of the plan that no group would use. A pair can appear once per agreeing band.
    With `best`, pairs that are farther than another one of the same searched row may be missing.
    """
    spark = searched.sparkSession
    steps = [(1 << 62, layout(radius, bands))] if bands else layout_steps(radius, (2, 3, 4, 5, 6, 8, 11), largest)
    near, far = stored.withColumnRenamed(bits, "near"), searched
    if before:
        near, far = near.filter(F.col(f"first_{before}").isNotNull()), far.filter(F.col(before).isNotNull())
    # Of each layout: keys a value lists on both sides. Cells are rows and columns of a grid.
    n, tag, cells, listed = F.col("__n"), F.lit(len(steps) - 1), F.lit(1), F.lit(0)
    for i in reversed(range(len(steps) - 1)):
        tag = F.when(n <= steps[i][0], i).otherwise(tag)
    for i, (_, made) in enumerate(steps):
        listed = F.when(F.col("layout") == i, sum(b.keys(True) + b.keys(False) for b in made)).otherwise(listed)
        if made == WHOLE_GROUP:
            cells = F.when(F.col("layout") == i, F.ceil(n / CELL_VALUES).cast("int")).otherwise(cells)
    sizes = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("layout", tag).withColumn("__cells", cells)
    total = sizes.agg(F.sum(n * listed * F.col("__cells"))).first()[0] or 0
    sizes = sizes.drop("__n")
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_KEYS)
    every = F.explode(F.sequence(F.lit(0), F.col("__cells") - 1))
    own = lambda value: F.pmod(F.xxhash64(value), F.col("__cells")).cast("int")

    def placed(side: DataFrame, row, column) -> DataFrame:
        """With the cell a row meets others in, and the bucket of cells it is compared in."""
        side = side.withColumn("__row", row).withColumn("__column", column)
        side = side.withColumn("__cell", F.xxhash64(*keys, "band", "__key", "__row", "__column"))
        side = side.withColumn("__bucket", F.pmod("__cell", F.lit(buckets)).cast("int"))
        return side.drop("band", "__key", "__cells", "__row", "__column").repartition(buckets, "__bucket")

    near = _keyed(near.join(sizes, keys), band_table(spark, steps, searched=False), "near")
    far = _keyed(far.join(sizes, keys), band_table(spark, steps, searched=True), bits)
    near, far = placed(near, every, own("near")), placed(far, own(bits), every)
    near = near.withColumnsRenamed({k: f"__near_{k}" for k in keys})
    asking = set(searched.columns)
    given = [*searched.columns, *[f"__near_{k}" for k in keys], "near", *[c for c in stored.columns if c not in (*keys, bits)]]
    fields = {f.name: f.dataType for f in (*far.schema, *near.schema)}
    schema = T.StructType([T.StructField(c, fields[c]) for c in given] + [T.StructField("distance", T.IntegerType())])

    def compare(stored_side: pa.Table, searched_side: pa.Table) -> pa.Table:
        numbers = lambda side, name: side.column(name).to_numpy()
        value, h = (numbers(*c).view(np.uint64) for c in ((stored_side, "near"), (searched_side, bits)))
        first, moment = (numbers(stored_side, f"first_{before}"), numbers(searched_side, before)) if before else (None, None)
        here, there = numbers(stored_side, "__cell"), numbers(searched_side, "__cell")
        a, b = np.argsort(here, kind="stable"), np.argsort(there, kind="stable")
        cells = np.intersect1d(here, there)
        edges = [np.searchsorted(x[o], cells, side=s) for x, o in ((here, a), (there, b)) for s in ("left", "right")]
        out = []
        for i, j, k, m in zip(*edges, strict=True):
            mine, asked = a[i:j], b[k:m]
            for y, x, d in _near(value[mine], first[mine] if before else None, h[asked], moment[asked] if before else None, at_least, radius, best):
                out.append((mine[y], asked[x], d))
        y, x, d = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        columns = [searched_side.column(c).take(pa.array(x)) if c in asking else stored_side.column(c).take(pa.array(y)) for c in given]
        return pa.Table.from_arrays([*columns, pa.array(d, pa.int32())], names=[*given, "distance"])

    pairs = near.groupBy("__bucket").cogroup(far.groupBy("__bucket")).applyInArrow(compare, schema)
    # Cells are told apart by a hash.
    for k in keys:
        pairs = pairs.filter(F.col(k).eqNullSafe(F.col(f"__near_{k}")))
    return pairs.drop(*[f"__near_{k}" for k in keys])


def distinct_values(uploads: DataFrame, session: str, arrival: str, bits: str) -> DataFrame:
    """One row per (session, value): copies are folded before any similarity work."""
    return (
        uploads.filter(F.col(bits).isNotNull())
        .groupBy(session, F.col(bits).alias("h"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min(arrival).alias(f"first_{arrival}"))
    )


def hamming_join(
    uploads: DataFrame, session: str, arrival: str, bits: str, radius: int = 10, bands: int | None = None,
) -> DataFrame:
    """Pairs of distinct fingerprints of a session within `radius`, older value first.

    Copies stay folded: `copies` and `near_copies` say how many uploads carry each value, so the pairs of
    uploads are all there without being listed one by one. NULL fingerprints never match.
    """
    values = distinct_values(uploads, session, arrival, bits)
    searched = values.withColumnRenamed(f"first_{arrival}", arrival)
    stored = values.withColumnRenamed("copies", "near_copies")
    largest = values.groupBy(session).count().agg(F.max("count")).first()[0] or 0
    pairs = near_values(searched, stored, [session], radius, before=arrival, bands=bands, largest=largest)
    return pairs.distinct()
