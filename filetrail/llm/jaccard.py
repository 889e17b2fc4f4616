"""N-gram Jaccard self-join with PartEnum signatures: sets that are similar enough share one exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filetrail.llm.common import lean, remove, screened, stage
from filetrail.llm.components import components
from filetrail.llm.shingles import mix, set_keys, shingle_sets, steps

MOST_SIGNATURES = 100  # of a small set and band
PER_DIFFERENCE = 2.2  # of a large one, for each element that may differ
BUCKET_ENTRIES = 1_000_000
HEAVY_CLASSES = 100_000
FREQUENT_SHINGLES = 200_000
LISTED = 1 << 17  # elements listed at a time
LEAST_SLOTS, MOST_SLOTS = 128, 1 << 15  # parities of a set
FREQUENT = 300  # a shingle that one document in so many has is frequent


@dataclass(frozen=True)
class Band:
    """One instance of the scheme: pairs whose larger set has between `low` and `high` elements."""

    number: int
    low: int
    high: int
    differ: int  # most elements in which such a pair can differ
    parts: int  # first-level parts
    spare: int  # of them, more than the differences can spoil
    second: int  # second-level parts of each
    leave: int  # of them, left out of a signature

    @property
    def choices(self) -> np.ndarray:
        """Which second-level parts each signature of a part holds."""
        out = np.ones((math.comb(self.second, self.leave), self.second), bool)
        for row, left in enumerate(combinations(range(self.second), self.leave)):
            out[row, list(left)] = False
        return out


def _layout(differ: int) -> tuple[int, int, int, int]:
    """(parts, spare, second, leave) whose signatures hold most of a set, among those with few enough signatures."""
    best = (0.0, 0, 0, 0, 0)
    for leave in range(1, 8):
        parts = differ // (leave + 1) + 1
        spare = parts // 3
        for second in range(leave + 1, leave + 8):
            if (parts + spare) * math.comb(second, leave) <= max(MOST_SIGNATURES, PER_DIFFERENCE * (differ + 1)):
                best = max(best, ((second - leave) / second / (parts + spare), parts + spare, spare, second, leave))
    return best[1:]


def bands(threshold: Fraction, largest: int) -> list[Band]:
    """Bands of sizes up to `largest`, each up to 1/threshold wide.

    A pair with similarity t differs in at most (1 - t) / (1 + t) of the sum of its sizes. Differences can spoil fewer than
    parts - spare first-level parts with more than `leave` of them, so more than `spare` parts hold at most that many,
    and each of those has a signature that leaves the second-level parts of its differences out.
    """
    out, low = [], 1
    while low <= largest:
        high = max(low, math.floor(low / threshold))
        differ = math.floor((1 - threshold) / (1 + threshold) * 2 * high)
        out.append(Band(len(out), low, high, differ, *_layout(differ)))
        low = high + 1
    return out


def signatures(
    values: np.ndarray, bounds: np.ndarray, layout: list[Band], threshold: Fraction, frequent: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number) of all sets, for the band of their size and for those above that can hold a partner.

    The weight of a signature is its number of elements that are not frequent, so it depends on content alone. A set leaves out what
    is lighter than its own limit: the highest for which at most `spare` parts have a signature below it. Of a pair's unspoilt
    parts, more than `spare`, one has nothing below the higher of both limits, so a signature they share stays.
    """
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    near = np.searchsorted(frequent, values)
    rare = frequent[np.minimum(near, len(frequent) - 1)] != values if len(frequent) else np.ones(len(values), bool)
    found, whose = [], []
    for band in layout:
        if not band.differ:
            continue  # only equal sets, which are one class already
        own = np.flatnonzero((sizes >= math.ceil(threshold * band.low)) & (sizes <= band.high))
        if not len(own):
            continue
        place = np.full(len(sizes), -1)
        place[own] = np.arange(len(own))
        mine = place[owner] >= 0
        elements = values[mine]
        width = band.parts * band.second
        slot = place[owner[mine]] * width + (mix(elements ^ np.uint64(band.number)) % np.uint64(width)).astype(np.int64)
        sums = np.zeros(len(own) * width, np.uint64)
        np.add.at(sums, slot, mix(elements + np.uint64(band.number)))
        counts = np.bincount(slot[rare[mine]], minlength=len(sums)).astype(np.float32)
        choices = band.choices
        held = counts.reshape(-1, band.second) @ choices.T.astype(np.float32)
        total = sums.reshape(-1, band.second)
        value = np.zeros((len(total), len(choices)), np.uint64)
        for j in range(band.second):
            value += np.where(choices[:, j], total[:, j:j + 1], np.uint64(0))
        label = mix(np.arange(band.parts * len(choices), dtype=np.uint64) + np.uint64(band.number << 32))
        value = mix(value.reshape(len(own), -1) ^ label)
        held = held.reshape(len(own), band.parts, -1)
        limit = np.sort(held.min(2), axis=1)[:, band.spare]
        keep = (held >= limit[:, None, None]).reshape(len(own), -1)
        found.append(value[keep])
        whose.append(np.broadcast_to(own[:, None], keep.shape)[keep])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(whose)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a, np.uint64).view(np.int64))


def sizes_and_classes(docs: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """doc_id, n_shingles, two hashes and the parities of each document's set; equal hashes are one class.

    Rows with `shingle` true instead count, in n_shingles, a shingle (node) that many documents of one piece of the input have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lists = ["doc_id", "n_shingles", "node", "check", "shingle", "marks"], pa.list_(pa.int64())
        for batch in batches:
            for a, b, raw, offsets in steps(batch, "text"):
                values, bounds = shingle_sets(raw, offsets, words)
                one, two = set_keys(values, bounds)
                marks = [parities(values[i:j], parity_bits(j - i, threshold)) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[a:b], pa.array(np.diff(bounds)), _signed(one), _signed(two), pa.array(np.zeros(b - a, bool)),
                    pa.array(marks, lists)], names=names)
                values.sort()
                starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
                counts = np.diff(np.append(starts, len(values)))
                many = counts >= max(3, (b - a) // FREQUENT)
                n = int(many.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(n, pa.int64()), pa.array(counts[many]), _signed(values[starts[many]]), pa.array(np.zeros(n, np.int64)),
                    pa.array(np.ones(n, bool)), pa.nulls(n, lists)], names=names)

    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, node long, check long, shingle boolean, marks array<long>")


def _groups(docs: DataFrame, words: int, threshold: Fraction, facts: DataFrame, shingles: DataFrame) -> DataFrame:
    """(gid, node): distinct sets of two or more classes that share a signature.

    Signatures travel in packed chunks, one per bucket and few MB of text. Classes with very many copies send their signatures
    once: at most `HEAVY_CLASSES` of them, so their list is small whatever the input.
    """
    totals = facts.agg(F.sum("n_shingles").alias("n"), F.max("n_shingles").alias("largest"), F.count("*").alias("rows")).first()
    layout = bands(threshold, totals["largest"] or 0)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * width, int(totals["n"] or 0) // BUCKET_ENTRIES)
    heavy = facts.filter("n_shingles > 0").groupBy("node").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter(
        F.col("n") > max(64, totals["rows"] // HEAVY_CLASSES)).select("node", "doc_id").collect()
    speaker = {r["node"]: r["doc_id"] for r in heavy}
    # The most frequent shingles, a list of bounded length, say which signatures are weak.
    often = shingles.groupBy("node").agg(F.sum("n_shingles").alias("n")).filter(
        F.col("n") > max(4, totals["rows"] // FREQUENT)).orderBy(F.desc("n")).limit(FREQUENT_SHINGLES).select("node").collect()
    frequent = np.sort(np.array([r["node"] for r in often], np.int64).view(np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, raw, offsets in steps(batch, "text"):
                values, bounds = shingle_sets(raw, offsets, words)
                nodes = set_keys(values, bounds)[0]
                if speaker:
                    said = [speaker.get(n, d) == d for n, d in zip(nodes.view(np.int64).tolist(), ids[a:b].to_pylist(), strict=True)]
                    silent = ~np.repeat(np.array(said), np.diff(bounds))
                    sizes = np.where(said, np.diff(bounds), 0)
                    values, bounds = values[~silent], np.concatenate([[0], np.cumsum(sizes)])
                found, whose = signatures(values, bounds, layout, threshold, frequent)
                bucket = ((found >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                order = np.argsort(bucket, kind="stable")
                found, whose, bucket = found[order], whose[order].astype(np.uint16), bucket[order]
                edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
                rows = list(zip(edges, [*edges[1:], len(bucket)], strict=True)) if len(bucket) else []
                chosen = [np.unique(whose[i:j], return_inverse=True) for i, j in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(bucket[i]) for i, _ in rows], pa.int32()),
                    pa.array([found[i:j].tobytes() for i, j in rows], pa.binary()),
                    pa.array([nodes[u].tobytes() for u, _ in chosen], pa.binary()),
                    pa.array([at.astype(np.uint16).tobytes() for _, at in chosen], pa.binary()),
                ], names=["bucket", "found", "nodes", "at"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for bucket, found, nodes, at in zip(*columns, strict=True):
                if bucket != current and held:
                    yield _met(held)
                    held = []
                current = bucket
                held.append((np.frombuffer(found, np.uint64), np.frombuffer(nodes, np.uint64)[np.frombuffer(at, np.uint16)]))
        if held:
            yield _met(held)

    chunks = docs.mapInArrow(lean(sign), "bucket int, found binary, nodes binary, at binary")
    met = chunks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), "gid long, node long")
    return stage(met.distinct(), "jaccard-groups")


def _met(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Distinct groups of the nodes that share a signature in one bucket."""
    found, nodes = (np.concatenate(part) for part in zip(*held, strict=True))
    order = np.argsort(found)
    found = found[order]
    again = np.zeros(len(found), bool)
    again[1:] = found[1:] == found[:-1]
    shared = again.copy()
    shared[:-1] |= again[1:]
    found, nodes = found[shared], nodes[order][shared]
    order = np.lexsort((nodes, found))
    found, nodes = found[order], nodes[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (nodes[1:] != nodes[:-1])
    found, nodes = found[new], nodes[new]
    starts = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(found)))
    gid = mix(np.add.reduceat(mix(nodes), starts)) if len(starts) else np.zeros(0, np.uint64)
    _, kept = np.unique(gid, return_index=True)
    kept = kept[sizes[kept] > 1]
    take = np.repeat(starts[kept] - (np.cumsum(sizes[kept]) - sizes[kept]), sizes[kept]) + np.arange(sizes[kept].sum())
    return pa.RecordBatch.from_arrays([_signed(np.repeat(gid[kept], sizes[kept])), _signed(nodes[take])], names=["gid", "node"])


def _elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements of an Arrow column of sets, not copied, and where each set begins (one more entry than sets)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(np.uint64), (at - at[0]) // 8


def _sets(docs: DataFrame, words: int, facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, elements): the sets of the wanted classes, from the text of one document of each."""
    one = wanted.join(facts.filter("n_shingles > 0"), "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    texts = screened(docs, one, "doc_id").filter("may").join(one.hint("shuffle_hash"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("node").to_numpy()
            for a, b, raw, offsets in steps(batch, "text"):
                values, bounds = shingle_sets(raw, offsets, words)
                nodes = set_keys(values, bounds)[0].view(np.int64)
                right = np.flatnonzero(nodes == asked[a:b])  # a doc_id may stand for several rows
                yield pa.RecordBatch.from_arrays([
                    pa.array(nodes[right]),
                    pa.array([values[bounds[i]:bounds[i + 1]].tobytes() for i in right], pa.binary())], names=["node", "elements"])

    return stage(texts.select("node", "text").mapInArrow(lean(run), "node long, elements binary").dropDuplicates(["node"]), "jaccard-sets")


def _shape(sets: DataFrame) -> DataFrame:
    """(node, size, shared): elements of each set, and how many of them some other of these sets has."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            elements, bounds = _elements(batch.column("elements"))
            for start in range(0, len(elements), LISTED):  # rows of a step, whatever the sets' sizes
                end = min(start + LISTED, len(elements))
                owner = np.searchsorted(bounds, np.arange(start, end), side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(nodes[owner]), _signed(elements[start:end])], names=["node", "element"])

    alone = sets.mapInArrow(lean(listed), "node long, element long").groupBy("element").agg(
        F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    return sets.select("node", (F.octet_length("elements") / 8).cast("long").alias("size")).join(alone, "node", "left").select(
        "node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("shared"))


def _enough(threshold: Fraction) -> Column:
    """Whether the sets of a_size, a_shared and b_size, b_shared can be similar enough."""
    common = F.least("a_shared", "b_shared")
    return threshold.denominator * common >= threshold.numerator * (F.col("a_size") + F.col("b_size") - common)


def _verified(pairs: DataFrame, sets: DataFrame, shape: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b, linked) of the pairs, staged: exact test on the sets, for those that their shapes do not rule out."""
    above, below = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, left_at), (right, right_at) = _elements(batch.column("x")), _elements(batch.column("y"))
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = left[left_at[i]:left_at[i + 1]], right[right_at[i]:right_at[i + 1]]
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                linked[i] = below * common >= above * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    for side in "ab":
        pairs = pairs.join(shape.select(*(F.col(c).alias(n) for c, n in (
            ("node", side), ("size", f"{side}_size"), ("shared", f"{side}_shared")))), side)
    judged = stage(pairs.select("a", "b", _enough(threshold).alias("open")), "jaccard-judged")
    x = sets.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    tested = judged.filter("open").select("a", "b").join(x, "a").join(y, "b").mapInArrow(lean(run), "a long, b long, linked boolean")
    return stage(tested.unionByName(judged.filter("not open").select("a", "b", F.lit(False).alias("linked"))), "jaccard-tested")


def _labelled(groups: DataFrame, tested: DataFrame) -> DataFrame:
    """Groups that hold several components, as (gid, node, comp)."""
    labels = components(tested.filter("linked"))
    known = groups.join(labels, "node", "left").select("gid", "node", F.coalesce("label", "node").alias("comp"))
    split = known.groupBy("gid").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("gid")
    return stage(known.join(split, "gid"), "jaccard-split")


def parities(elements: np.ndarray, bits: int) -> np.ndarray:
    """One bit per slot, packed in 64-bit integers: whether an odd number of the elements falls into the slot."""
    slots = (mix(elements) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=bits).astype(np.uint8) & 1).view(np.int64)


def parity_bits(size: int, threshold: Fraction) -> int:
    """Slots for a set: a power of two, about eight or more for each element in which it may differ from one of its size."""
    wanted = 16 * size * (1 - threshold) / (1 + threshold)
    return min(max(1 << math.ceil(wanted).bit_length(), LEAST_SLOTS), MOST_SLOTS)


def _marked(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(node, marks, coarse): the parities of each set, and those for half as many slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, bounds = _elements(batch.column("elements"))
            marks = [parities(elements[a:b], parity_bits(b - a, threshold)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            halves = [m[:len(m) // 2] ^ m[len(m) // 2:] for m in marks]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(marks, lists), pa.array(halves, lists)], names=["node", "marks", "coarse"])

    return sets.mapInArrow(lean(run), "node long, marks array<long>, coarse array<long>")


def _close(threshold: Fraction) -> Column:
    """Whether the parities of two sets leave open that they are similar enough.

    A slot whose parities differ holds an element of only one of them, so two sets differ in no fewer elements than slots.
    """
    wide, narrow = F.size("a_marks"), F.size("b_marks")

    def apart(a: str, b: str) -> Column:
        unequal = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        return F.aggregate(unequal, F.lit(0), lambda n, more: n + more)

    differ = F.when(wide == narrow, apart("a_marks", "b_marks")).when(wide == 2 * narrow, apart("a_coarse", "b_marks")).when(
        narrow == 2 * wide, apart("a_marks", "b_coarse")).otherwise(0)
    above, below = threshold.numerator, threshold.denominator
    return (below + above) * differ <= (below - above) * (F.col("a_size") + F.col("b_size"))


def _meeting(groups: DataFrame, counted: DataFrame, threshold: Fraction) -> DataFrame:
    """The rows of `groups` whose set has another one in the group that sizes and parities do not rule out, staged.

    Two sets that are similar enough keep the rows of every group they share. Most groups come from passages that texts without any other
    likeness have in common; their sets go here by a few bytes each, before the sets themselves move. The parities are compared inside the join, which gives a row
    at most once.
    """
    parities_of = counted.filter("n_shingles > 0").select("node", F.col("n_shingles").alias("size"), "marks").dropDuplicates(["node"])
    half = F.expr("size(marks) div 2")
    coarse = F.zip_with(F.slice("marks", F.lit(1), half), F.slice("marks", half + 1, half), lambda x, y: x.bitwiseXOR(y))
    known = groups.join(parities_of, "node").select("gid", "node", "size", "marks", coarse.alias("coarse"))
    left, right = (known.select("gid", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "size", "marks", "coarse"))) for side in "ab")
    fits = threshold.denominator * F.least("a_size", "b_size") >= threshold.numerator * F.greatest("a_size", "b_size")
    other = F.col("a_node") != F.col("b_node")
    kept = left.join(right, (left["gid"] == right["gid"]) & other & fits & _close(threshold), "left_semi")
    return stage(kept.select("gid", F.col("a_node").alias("node")), "jaccard-meeting")


def _ranked(split: DataFrame) -> DataFrame:
    """(node, comp, gid, earlier): a row for each group of a node, with those of its groups that come before, the largest first.

    Groups of near copies overlap widely, so two sets meet in many; they are a pair only in the first. A node is in no more groups than
    its set has signatures.
    """
    sizes = split.groupBy("gid").agg(F.count("*").alias("n"))
    listed = split.join(sizes, "gid").groupBy("node").agg(
        F.min("comp").alias("comp"), F.sort_array(F.collect_set(F.struct((-F.col("n")).alias("n"), "gid")))["gid"].alias("gids"))
    each = listed.select("node", "comp", "gids", F.posexplode("gids").alias("at", "gid"))
    return each.select("node", "comp", "gid", F.slice("gids", F.lit(1), F.col("at")).alias("earlier"))


def _possible(split: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(a, b): pairs of different components in a group whose sets can still be similar enough.

    Elements that no other set of these groups has cannot be common, so the rest of the smaller one bounds what two sets share; the
    parities of both bound it too. Near copies of one text that are each changed too much fall away by this, without their sets
    being brought together, and a pair comes out of the join once, however many groups it shares. What is left to grow with the square of a
    group is the comparison of parities inside the join.
    """
    live = sets.join(split.select("node").distinct(), "node")
    known = stage(_ranked(split).join(_shape(live), "node").join(_marked(live, threshold), "node"), "jaccard-live")
    columns = ("node", "comp", "size", "shared", "marks", "coarse", "earlier")
    left, right = (known.select("gid", *(F.col(c).alias(f"{side}_{c}") for c in columns)) for side in "ab")
    other = (F.col("a_node") < F.col("b_node")) & (F.col("a_comp") != F.col("b_comp"))
    first = ~F.arrays_overlap("a_earlier", "b_earlier")
    return left.join(right, (left["gid"] == right["gid"]) & other & _enough(threshold) & _close(threshold) & first).select(
        F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def link_components(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """Components of documents whose word-shingle sets have Jaccard similarity `threshold` or more: exact, no pair is missed.

    Equal sets are one class. Classes that share a signature form a group; a class that no other of the group can be similar to leaves it. Groups shrink without listing their pairs: a class is tested with the
    smallest class it meets; as long as links turn up, one class of each component left in a group is tested with the group's
    smallest; at last the pairs between different components that still share a group are tested, all of them.
    Returns doc_id, n_shingles, component_id (smallest doc_id reachable by links). Texts without words (null, empty) have 0 shingles
    and link with nothing. Repeated rows and doc_ids are rows of their own; a row with a null doc_id joins those with an equal set, and
    has no component if none of them has a doc_id. Other columns are ignored; an empty table gives no row.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    counted = stage(sizes_and_classes(docs, words, threshold), "jaccard-facts")
    facts = counted.filter(~F.col("shingle")).drop("shingle", "marks")
    groups = _groups(docs, words, threshold, facts, counted.filter("shingle"))
    if not groups.isEmpty():
        groups = _meeting(groups, counted.filter(~F.col("shingle")), threshold)
    if groups.isEmpty():
        label = None
    else:
        centres = groups.groupBy("gid").agg(F.min("node").alias("a"))
        pairs = groups.join(centres, "gid").groupBy(F.col("node").alias("b")).agg(F.min("a").alias("a")).filter("a != b")
        sets = _sets(docs, words, facts, groups.select("node").distinct())
        shape = stage(_shape(sets), "jaccard-shape")
        tested = _verified(pairs, sets, shape, threshold)
        while True:
            split = _labelled(groups, tested)
            heads = split.groupBy("gid", "comp").agg(F.min("node").alias("b"))
            first = heads.groupBy("gid").agg(F.min("b").alias("a"))
            pairs = heads.join(first, "gid").filter("a != b").select("a", "b").distinct()
            more = _verified(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), sets, shape, threshold)
            tested = tested.unionByName(more)
            if more.filter("linked").isEmpty():
                break
        pairs = _possible(split, sets, threshold)
        tested = tested.unionByName(_verified(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), sets, shape, threshold))
        label = components(tested.filter("linked"))
    known = facts.withColumn("label", F.col("node")) if label is None else facts.join(label, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    full = known.filter("n_shingles > 0")
    least = full.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return full.join(least, "label").select("doc_id", "n_shingles", "component_id").unionByName(
        known.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """One document of each component stays, the one of smallest doc_id, with all its columns. Rows without doc_id stay."""
    found = link_components(docs, words, threshold)
    linked = stage(found, "jaccard-components")
    remove(found)
    go = stage(linked.filter("doc_id != component_id").select("doc_id").distinct(), "jaccard-copies")
    sure = screened(docs, go, "doc_id")
    kept = sure.filter("not may").drop("may").unionByName(
        sure.filter("may").drop("may").join(go.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns))  # one plan at every size
    if linked.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    named = kept.filter("doc_id is not null")
    return named.dropDuplicates(["doc_id", "text"]).unionByName(kept.filter("doc_id is null"))
