"""Texts that share many word sequences: an exact overlap join by prefix filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filetrail.functions.binary import indexes, let
from filetrail.session import stage

# Families that the texts of one block hold, on average, and families of partners that are looked up at a time.
BLOCK_ENTRIES, LOOKED_UP = 1 << 21, 1 << 20


class _Texts:
    """The families of the texts of one cell, numbered densely."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        ids, copies, lengths, families, weights = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(ids)
        self.ids, self.copies, self.lengths, self.starts = ids[order], copies[order], lengths[order], (np.cumsum(lengths) - lengths)[order]
        kinds, self.families = np.unique(families, return_inverse=True)
        self.weights, self.weight = weights, np.zeros(len(kinds), np.int64)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weight of the families that texts a and b (places in `ids`; equal ones of a stand together) have in common."""
        out, sizes = np.zeros(len(a), np.int64), self.lengths[b]
        looked = np.cumsum(sizes) // LOOKED_UP
        cuts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (looked[1:] != looked[:-1]))).tolist()
        for low, high in zip(cuts, [*cuts[1:], len(a)], strict=True):
            own = slice(self.starts[a[low]], self.starts[a[low]] + self.lengths[a[low]])
            self.weight[self.families[own]] = self.weights[own]
            ends = np.cumsum(sizes[low:high])
            first = ends - sizes[low:high]
            at = np.repeat(self.starts[b[low:high]] - first, sizes[low:high]) + np.arange(ends[-1])
            out[low:high] = np.add.reduceat(self.weight[self.families[at]], first)
            self.weight[self.families[own]] = 0
        return out


def _overlaps(min_shared: int):
    """Rows of cells, in order, with the texts of a cell before its pairs, to pairs that share enough."""
    names = ["doc_id", "other_id", "copies", "other_copies", "shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, texts = None, [], None
        for batch in batches:
            cells, pairs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "pair"))
            turns = np.flatnonzero(np.append(True, (cells[1:] != cells[:-1]) | (pairs[1:] != pairs[:-1]))).tolist() if len(cells) else []
            for low, high in zip(turns, [*turns[1:], len(cells)], strict=True):
                if cells[low] != current:
                    current, parts, texts = cells[low], [], None
                rows = batch.slice(low, high - low)
                ids = rows.column("doc_id").to_numpy()
                if not pairs[low]:
                    families, weights = rows.column("families"), rows.column("weights")
                    lengths = families.value_lengths().to_numpy(zero_copy_only=False)
                    parts.append((ids, rows.column("copies").to_numpy(zero_copy_only=False), lengths, families.flatten().to_numpy(), weights.flatten().to_numpy()))
                    continue
                if texts is None:
                    texts, parts = _Texts(parts), []
                other = rows.column("other_id").to_numpy()
                a, b = np.searchsorted(texts.ids, ids), np.searchsorted(texts.ids, other)
                shared = texts.shared(a, b)
                enough = shared >= min_shared
                a, b = a[enough], b[enough]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
                    texts.ids[a], texts.ids[b], texts.copies[a], texts.copies[b], shared[enough])], names=names)

    return run


def shared_shingle_match(docs: DataFrame, min_shared: int = 25, words: int = 5) -> DataFrame:
    """Pairs of different texts with at least `min_shared` distinct `words`-word shingles in common.

    Returns doc_id, other_id (the smallest ids of either text), copies, other_copies, shared. Equal texts are one.
    Shingles that occur in the same texts are one family, told by their number of texts and two hashes of these: a passage is
    one element with the weight of its shingles, however many they are. Of two sets with that overlap, the families that remain
    without the most frequent ones of up to `min_shared - 1` in weight must meet, so only those are joined; none is dropped for being
    frequent. Shingles that one text alone has meet nothing and go before anything but their count moves.

    Pairs to be compared move as two ids. Texts fall into blocks by hash, and a text's families go once to each cell of the grid of blocks,
    where the pairs of the cell pass by them in batches, so a text does not move once per partner.
    """
    texts = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    grams = let(F.split("text", " "), lambda cut: F.transform(
        indexes(F.size(cut) - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice(cut, i + 1, words), " "))))
    long_enough = F.size(F.split("text", " ")) >= min_shared + words - 1
    # The families and the join below both use all its columns, so this exchange is made once and read twice.
    rows = texts.filter(long_enough).select("doc_id", "copies", F.explode(F.array_distinct(grams)).alias("gram")).repartition("gram")
    met = rows.groupBy("gram").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("s"), F.bit_xor(F.xxhash64("copies", "doc_id")).alias("x"))
    family = met.filter("n > 1").select("gram", "n", F.xxhash64("n", "s", "x").alias("family"))
    members = stage(rows.join(family, "gram").groupBy("doc_id", "copies", "n", "family").agg(
        F.count("*").alias("weight")), "shingle-families")
    down = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), F.col("family").desc())
    prefix = members.withColumn("above", F.sum("weight").over(down)).filter(F.col("above") >= min_shared).select("doc_id", "family")
    other = prefix.withColumnRenamed("doc_id", "other_id")
    pairs = prefix.join(other, "family").filter("doc_id < other_id").select("doc_id", "other_id").distinct()

    blocks = 1 + members.count() // BLOCK_ENTRIES
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    cell = lambda x, y: (F.least(x, y) * blocks + F.greatest(x, y)).alias("cell")
    listed = members.filter("doc_id is not null").groupBy("doc_id", "copies").agg(
        F.collect_list(F.struct("family", "weight")).alias("all"), F.sum("weight").alias("total"))
    texts = listed.filter(F.col("total") >= min_shared).select(
        "doc_id", "copies", F.col("all.family").alias("families"), F.col("all.weight").alias("weights"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("beside")).select(
        cell(block("doc_id"), F.col("beside")), F.lit(False).alias("pair"), "doc_id", "copies", "families", "weights")
    asked = pairs.select(cell(block("doc_id"), block("other_id")), F.lit(True).alias("pair"), "doc_id", "other_id")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = texts.unionByName(asked, allowMissingColumns=True).repartition(max(width, blocks * (blocks + 1) // 2), "cell")
    return both.sortWithinPartitions("cell", "pair", "doc_id").mapInArrow(
        _overlaps(min_shared), "doc_id long, other_id long, copies long, other_copies long, shared long")
