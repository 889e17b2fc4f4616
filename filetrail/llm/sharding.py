"""Histogram sort: exact bytes below candidate boundaries, counted again and again until every shard's splitter fits."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filetrail.llm.common import stage

TOP = 1 << 64
PROBES = 16  # candidates in each open bracket of a round
PIECE_ROWS = 1_000_000
RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
Key = tuple[int, int]
Bracket = tuple[int, int, int, int]  # key, bytes below it, next key, bytes below that
Bin = tuple[int, int, int]  # bytes between two probes, least and largest key there


def _between(rows: DataFrame, probes: dict[int, list[int]]) -> dict[tuple[int, int], Bin]:
    """The rows of each `part` between its probes: (part, probes at or below) -> exact bytes, least and largest key. Empty bins are absent.

    Keys (`key`) are signed longs seen as unsigned. A batch is counted in place and sends one row per bin it touches; as many rows
    as there are probes come back.
    """
    edges = {part: np.array(sorted(found), np.uint64) for part, found in probes.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            parts, sizes = batch.column("part").to_numpy(), batch.column("size").to_numpy()
            for part in np.unique(parts).tolist():
                own, weights = keys[parts == part], sizes[parts == part]
                order = np.argsort(own)
                own, weights = own[order], weights[order]
                bins, first = np.unique(np.searchsorted(edges[part], own, side="right"), return_index=True)
                last = np.append(first[1:], len(own)) - 1
                flip = np.uint64(1 << 63)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(bins), part, np.int32)), pa.array(bins.astype(np.int32)), pa.array(np.add.reduceat(weights, first)),
                    pa.array((own[first] ^ flip).view(np.int64)), pa.array((own[last] ^ flip).view(np.int64)),
                ], names=["part", "bin", "bytes", "least", "largest"])

    found = rows.select("part", "key", "size").mapInArrow(count, "part int, bin int, bytes long, least long, largest long")
    bins = found.groupBy("part", "bin").agg(
        F.sum("bytes").alias("bytes"), F.min("least").alias("least"), F.max("largest").alias("largest"))
    return {(r["part"], r["bin"]): (r["bytes"], r["least"] + (1 << 63), r["largest"] + (1 << 63)) for r in bins.collect()}


def split(rows: DataFrame, targets: dict[int, list[int]], slack: float) -> dict[int, list[Bracket]]:
    """For each target (bytes below it within its `part`) the bracket that closed on it.

    A bracket closes when one of its ends is within `slack` bytes of the target, or when it holds one key value only. All
    open brackets of all parts are probed in the same round, and a bracket shrinks to the keys that lie in it, so the
    rounds follow the logarithm of the keys in a bracket and not that of the key range.
    """
    brackets: dict[int, list[Bracket]] = {}

    def is_open(bracket: Bracket, target: int) -> bool:
        lo, a, hi, b = bracket
        return hi - lo > 1 and min(target - a, b - target) > slack

    whole = _between(rows, {part: [] for part in targets})
    for part, wanted in targets.items():
        total, least, largest = whole.get((part, 0), (0, 0, 0))
        brackets[part] = [(least, 0, largest + 1, total)] * len(wanted)
    while True:
        probes: dict[int, list[int]] = {}
        for part, wanted in targets.items():
            todo = [br for br, t in zip(brackets[part], wanted, strict=True) if is_open(br, t)]
            shared = {(br[0], br[2]): sum(o == br for o in todo) for br in todo}
            found = {lo + (hi - lo) * k // (PROBES * n + 1) for (lo, hi), n in shared.items() for k in range(1, PROBES * n + 1)}
            found.update(e for lo, hi in shared for e in (lo, hi))  # so that no bin reaches over the ends of a bracket
            if todo:
                probes[part] = sorted(found - {TOP})
        if not probes:
            return brackets
        bins = _between(rows.filter(F.col("part").isin(list(probes))), probes)
        for part, edges in probes.items():
            for i, target in enumerate(targets[part]):
                lo, below, hi, b = brackets[part][i]
                if not is_open(brackets[part][i], target):
                    continue
                end = (lo, below)
                for at in range(bisect_left(edges, lo) + 1, bisect_left(edges, hi) + 1):
                    n, least, largest = bins.get((part, at), (0, 0, 0))
                    if not n:
                        continue
                    if below + n > target:  # the target lies in this bin
                        brackets[part][i] = (least, below, largest + 1, below + n)
                        break
                    below, end = below + n, (largest + 1, below + n)
                else:
                    brackets[part][i] = (*end, hi, b)


def boundaries(rows: DataFrame, shards: int, slack: float) -> list[Key]:
    """Where shards 1, 2, .. begin, as (key, row): a row goes below a boundary if its (key, row) is smaller.

    Keys that are equal stay together unless their bytes are too many for the splitter to come within the slack; then the rows of
    all such keys are counted by row number, again in common rounds.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * j // shards for j in range(1, shards)]
    closed = split(rows.withColumn("part", F.lit(0)), {0: targets}, slack)[0]
    out: list[Key | None] = []
    inside: dict[int, list[int]] = {}
    for i, (lo, a, hi, b) in enumerate(closed):
        off, at = min((targets[i] - a, lo), (b - targets[i], hi))
        out.append((at, 0) if off <= slack else None)
        if off > slack:
            inside.setdefault(lo, []).append(i)
    if inside:
        part = sum((F.when(F.col("key") == F.lit(key - (1 << 63)), F.lit(g + 1)).otherwise(0) for g, key in enumerate(inside)), F.lit(0))
        own = rows.select(part.cast("int").alias("part"), F.col("row").bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("key"), "size")
        wanted = {g + 1: [targets[i] - closed[i][1] for i in held] for g, held in enumerate(inside.values())}
        found = split(own.filter("part > 0"), wanted, slack)
        for g, (key, held) in enumerate(inside.items()):
            for i, want, (r0, a0, r1, b0) in zip(held, wanted[g + 1], found[g + 1], strict=True):
                out[i] = (key, r0) if want - a0 <= b0 - want else (key, r1)
    return sorted(out)


def _shard(cuts: list[Key]) -> Column:
    """The number of boundaries at or below (key, row)."""
    above = [
        ((F.col("key") > key - (1 << 63)) | ((F.col("key") == key - (1 << 63)) & (F.col("row") >= row))).cast("int")
        for key, row in cuts if key < TOP]
    return sum(above, F.lit(0))


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.01, columns: tuple[str, ...] = ()) -> DataFrame:
    """Put every row into one of `shards` shards of near equal bytes (law `bytes`); a row is its text's UTF-8 bytes plus 16.

    Rows are ordered by the hash of their text, so equal texts lie together; splitters are refined until each is within
    `tolerance` of a shard's share of where it should be (or at the nearest row, where rows are larger than that), by
    counting all rows in each round. Only groups of equal texts larger than the tolerance are cut. Then rows are
    exchanged once, by shard and a slice of it, so that no task holds a whole shard; slots count on from slice to slice.
    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null), and the asked
    `columns`; those named like a column of the result come as `own_<name>`. Null texts have no bytes and the crc32 of none; nulls and repeats in doc_id and repeated rows are rows of their
    own; fewer rows than shards leave shards empty; an empty table gives no row.
    """
    text = F.coalesce("text", F.lit(""))
    asked = {c: f"own_{i}" for i, c in enumerate(columns)}
    rows = stage(docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row"), *[F.col(c).alias(o) for c, o in asked.items()]), "shard-rows")
    counts = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    slack = (counts["bytes"] or 0) / shards * tolerance
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(-(-width // shards), -(-counts["rows"] // (PIECE_ROWS * shards)), 1)
    placed = rows.withColumns({
        "shard": _shard(boundaries(rows, shards, slack)),
        "slice": F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"),
    })
    sizes = placed.groupBy("shard", "slice").count().orderBy("shard", "slice").collect()  # shards * slices numbers
    before, starts, last = 0, [], None
    for r in sizes:
        before = 0 if r["shard"] != last else before
        starts.append((r["shard"], r["slice"], before))
        before, last = before + r["count"], r["shard"]
    offsets = docs.sparkSession.createDataFrame(starts, "shard int, slice int, before long")
    order = Window.partitionBy("shard", "slice").orderBy("key", "row")
    return placed.withColumn("nth", F.row_number().over(order)).join(offsets, ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(o).alias(f"own_{c}" if c in RESULT else c) for c, o in asked.items()])
