"""Near-duplicate embeddings with an inverted multi-index: two codebooks on vector halves, whose product is a grid of cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filetrail.llm.common import stage
from filetrail.llm.components import components
from filetrail.llm.vectors import common_size, matrix, unit, whole

PER_CELL = 256  # vectors of one label in a cell, about
MOST_CENTRES = 256
SAMPLE = 20_000
BLOCK_ROWS = 2_048
SEED = 9


def codebook(points: np.ndarray, centres: int) -> np.ndarray:
    """Some rounds of k-means from chosen points."""
    rng = np.random.default_rng(SEED)
    book = points[rng.choice(len(points), min(centres, len(points)), replace=False)].copy()
    for _ in range(12):
        nearest = _squared(points, book).argmin(axis=1)
        for c in range(len(book)):
            own = points[nearest == c]
            if len(own):
                book[c] = own.mean(axis=0)
    return np.unique(book, axis=0)


def _squared(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((points * points).sum(1)[:, None] - 2 * points @ book.T + (book * book).sum(1), 0)


def _cell_bounds(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """How far at least each point is from each centre's cell: the distance to the border with the point's own cell."""
    far = _squared(points, book)
    own = far.argmin(axis=1)
    between = np.sqrt(_squared(book, book))
    gap = between[own]
    return np.where(gap > 0, (far - far[np.arange(len(points)), own][:, None]) / (2 * np.maximum(gap, 1e-12)), 0)


def multi_sequence(one: np.ndarray, two: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Grid cells in order of the sum of their halves' squared bounds, as long as the sum is within `reach`.

    Both halves are sorted; a cell is visited after the cells before it on either side, so only a border of candidates is held.
    """
    from heapq import heappop, heappush

    first, second = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    a, b = one.tolist(), two.tolist()
    out, border, reached = [], [(a[first[0]] + b[second[0]], 0, 0)], [0] * (len(first) + 1)
    while border:
        total, i, j = heappop(border)
        if total > reach:
            break
        out.append((first[i], second[j]))
        reached[i] = j + 1
        if i + 1 < len(first) and reached[i + 1] == j:
            heappush(border, (a[first[i + 1]] + b[second[j]], i + 1, j))
        if j + 1 < len(second) and (i == 0 or reached[i - 1] > j + 1):
            heappush(border, (a[first[i]] + b[second[j + 1]], i, j + 1))
    return out


def _links(stored: pa.Table, asked: pa.Table, size: int, threshold: float) -> pa.Table:
    """Of one block: for each vector with a link, the copies it links with here and the smallest node it is joined to here."""
    out = {"node": [], "links": [], "joined": []}
    if stored.num_rows and asked.num_rows:
        x, y = matrix(stored["vector"], size), matrix(asked["vector"], size)
        ux, uy = unit(x), unit(y)
        nodes, copies = stored["node"].to_numpy(), stored["copies"].to_numpy()
        asks, theirs = asked["node"].to_numpy(), asked["copies"].to_numpy()
        same = asked["same"].to_numpy(zero_copy_only=False)
        at_stored, at_asked = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        label_x, label_y = nodes.copy(), asks.copy()
        hits = []
        for a in range(0, len(y), BLOCK_ROWS):
            score = uy[a:a + BLOCK_ROWS] @ ux.T
            close = np.nonzero(np.abs(score - threshold) < 1e-9)
            if len(close[0]):  # near the threshold the measure itself decides
                p, q = y[close[0] + a], x[close[1]]
                score[close] = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1)))
            # Inside one cell each pair comes up twice; it counts where the asking node is the smaller.
            hit = (score >= threshold) & ~(same[a:a + BLOCK_ROWS, None] & (asks[a:a + BLOCK_ROWS, None] >= nodes))
            at_asked[a:a + BLOCK_ROWS] = hit @ copies
            at_stored += theirs[a:a + BLOCK_ROWS] @ hit
            hits.append(np.nonzero(hit))
        row = np.concatenate([h[0] + i * BLOCK_ROWS for i, h in enumerate(hits)])
        col = np.concatenate([h[1] for h in hits])
        while len(row):  # smallest node reachable inside the block
            before = label_x.copy(), label_y.copy()
            np.minimum.at(label_x, col, label_y[row])
            np.minimum.at(label_y, row, label_x[col])
            # A node that is on both sides has one label.
            if (before[0] == label_x).all() and (before[1] == label_y).all():
                break
        for n, count, label in ((nodes, at_stored, label_x), (asks, at_asked, label_y)):
            linked = count > 0
            out["node"].append(n[linked])
            out["links"].append(count[linked])
            out["joined"].append(label[linked])
    return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for k, v in out.items()})


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Vectors of one label with cosine `threshold` or more, linked: vec_id, n_links, component_id, kept; one row per row.

    Equal vectors of a label are one class. Unit vectors are cut in halves, each half is assigned to the nearest centre of a
    codebook learned from a bounded sample; a pair of centres is a cell of the grid. A vector visits cells in multi-sequence order of
    their distance bounds until no unvisited cell can hold a vector within the threshold, so the target recall is 1, and is compared there.
    A cell's vectors are spread over blocks; a block sends counts and one joining link per vector, never its pairs.

    Vectors that are null, zero, hold null or non-finite components, have another size than most, or no label link with nothing: no
    links, a component of their own. Repeated vec_ids are vectors of their own; rows without vec_id have no component and are not
    kept. Other columns are ignored; an empty table gives no row.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long"), "embedding", "label").withColumn("whole", whole() & F.col("label").isNotNull())
    size = common_size(rows.filter("whole"))
    taking = rows.withColumn("node", F.when(
        F.col("whole") & (F.size("embedding") == size), F.xxhash64(F.col("label").cast("string"), "embedding")))
    classes = stage(taking.filter("node is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("head"), F.first("label").cast("string").alias("label"),
        F.first("embedding").alias("vector")), "near-classes")
    totals = classes.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    if not totals["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    centres = min(MOST_CENTRES, max(2, math.ceil(math.sqrt(totals["n"] / totals["labels"] / PER_CELL))))
    sample = unit(np.array([r["vector"] for r in classes.orderBy("node").limit(SAMPLE).select("vector").collect()], float))
    half = max(1, size // 2)
    left, right = codebook(sample[:, :half], centres), codebook(sample[:, half:], centres)
    reach = (2 - 2 * threshold) * (1 + 1e-9) + 1e-9
    kind = classes.schema["vector"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit(matrix(batch.column("vector"), size))
            own = _squared(units[:, :half], left).argmin(1) * len(right) + _squared(units[:, half:], right).argmin(1)
            one, two = _cell_bounds(units[:, :half], left) ** 2, _cell_bounds(units[:, half:], right) ** 2
            cells = [[i * len(right) + j for i, j in multi_sequence(a, b, reach)] for a, b in zip(one, two, strict=True)]
            # A pair of different cells is found from the smaller one.
            cells = [[c for c in visited if c >= o] for visited, o in zip(cells, own.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "copies", "label", "vector")), pa.array(own), pa.array(cells, pa.list_(pa.int64()))],
                names=["node", "copies", "label", "vector", "cell", "visits"])

    index = stage(classes.select("node", "copies", "label", "vector").mapInArrow(
        assign, f"node long, copies long, label string, vector {kind}, cell long, visits array<long>"), "near-index")
    # Aliases make the visiting side's columns its own, since both sides of the comparison come from one table.
    visits = index.select(
        *(F.col(c).alias(c) for c in ("node", "copies", "label", "vector")), F.col("cell").alias("own"), F.explode("visits").alias("cell"))
    # Blocks of a cell: so many for its own vectors, so many for those that visit it.
    stored_n = index.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    asked_n = index.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(
        F.ceil(F.count("*") / (4 * BLOCK_ROWS)).alias("parts"))
    units = stored_n.join(asked_n, ["label", "cell"])
    salted = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node"), F.col("parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["label", "cell", "block", "part"]
    stored = index.join(units, ["label", "cell"]).withColumn("block", salted[0]).withColumn("part", each("parts")).select(
        *keys, "node", "copies", "vector")
    asked = visits.join(units, ["label", "cell"]).withColumn("part", salted[1]).withColumn("block", each("blocks")).select(
        *keys, "node", "copies", "vector", (F.col("own") == F.col("cell")).alias("same"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        return _links(a, b, size, threshold)

    found = stage(stored.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        compare, "node long, links long, joined long"), "near-links")
    labels = components(found.select(F.col("node").alias("a"), F.col("joined").alias("b")).distinct())
    counted = classes.select("node", "copies", "head").join(
        found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(labels, "node", "left").select(
        "node", "copies", "head", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("joined"))
    heads = counted.groupBy("joined").agg(F.min("head").alias("component"))
    known = counted.join(heads, "joined").select("node", (F.col("links") + F.col("copies") - 1).alias("links"), "component")
    return taking.select("vec_id", "node").join(known, "node", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"))
