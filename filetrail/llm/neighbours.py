"""Nearest neighbours by low-dimensional stable projections, kd-trees over them, and a chi-square test for when to stop."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filetrail.llm.common import stage
from filetrail.llm.vectors import common_size, matrix, unit, whole

PROJECTED = 8  # even, for the closed form of the distribution
SURE = 0.97  # of a true neighbour lying within the projected distance that is searched
CELL_ROWS = 16_384
LEAF_ROWS = 256
SAMPLE = 20_000
BLOCK_QUERIES = 20_000
SEED = 20


def chi_square_quantile(sure: float, degrees: int) -> float:
    """Where the chi-square distribution with an even number of degrees reaches `sure`."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(degrees // 2))
        low, high = (x, high) if 1 - tail < sure else (low, x)
    return high


def kd_split(points: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, list[int]]:
    """An order of the points and where each leaf of at most `leaf_rows` begins, by medians of the widest side."""
    order, starts, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf_rows:
            starts.append(a)
            continue
        own = order[a:b]
        side = int(np.argmax(np.ptp(points[own], axis=0)))
        middle = (b - a) // 2
        order[a:b] = own[np.argpartition(points[own, side], middle)]
        todo += [(a, a + middle), (a + middle, b)]
    return order, sorted(starts)


def kd_cells(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Splits (side, value) of a complete kd-tree with `cells` leaves (a power of two), in heap order."""
    splits: list[tuple[int, float]] = []
    level = [sample]
    while len(level) < cells:
        below = []
        for points in level:
            side = int(np.argmax(np.ptp(points, axis=0))) if len(points) else 0
            value = float(np.median(points[:, side])) if len(points) else 0.0
            splits.append((side, value))
            below += [points[points[:, side] < value], points[points[:, side] >= value]]
        level = below
    return splits


def cell_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if splits:
        side, value = np.array([s for s, _ in splits]), np.array([v for _, v in splits])
        for _ in range((len(splits) + 1).bit_length() - 1):
            node = 2 * node + 1 + (points[np.arange(len(points)), side[node]] >= value[node])
    return node - len(splits)


def _box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point (or one point) to each box."""
    gap = np.maximum(np.maximum(low - points, points - high), 0)
    return (gap * gap).sum(axis=-1)


def _search(index: pa.Table, asked: pa.Table, size: int, keep: int, reach: float) -> pa.Table:
    """Best `keep` (vec_id, score) of one cell for each query, nearest projections first, until the test holds."""
    vectors, points = unit(matrix(index["vector"], size)), matrix(index["point"], PROJECTED)
    ids = index["ids"].to_pylist()
    order, starts = kd_split(points, LEAF_ROWS)
    vectors, points, ids = vectors[order], points[order], [ids[i] for i in order]
    low = np.minimum.reduceat(points, starts, axis=0) if starts else points
    high = np.maximum.reduceat(points, starts, axis=0) if starts else points
    ends = [*starts[1:], len(points)]
    queries, at = unit(matrix(asked["vector"], size)), matrix(asked["point"], PROJECTED)
    limits = asked["worst"].to_numpy()
    keys, found_ids, found_scores = [], [], []
    for key, query, place, limit in zip(asked["key"].to_pylist(), queries, at, limits, strict=True):
        boxes = _box_distance(place, low, high)
        by_distance = np.argsort(boxes)
        scores, rows = np.zeros(0), np.zeros(0, np.int64)
        done, take, worst = 0, 2, limit
        while done < len(by_distance) and boxes[by_distance[done]] <= reach * (2 - 2 * worst):
            some = by_distance[done:done + take]
            done, take = done + take, 2 * take
            near = np.concatenate([np.arange(starts[i], ends[i]) for i in some])
            gap = points[near] - place
            near = near[(gap * gap).sum(1) <= reach * (2 - 2 * worst)]
            scores, rows = np.concatenate([scores, vectors[near] @ query]), np.concatenate([rows, near])
            if len(scores) > keep:
                bar = np.partition(scores, -keep)[-keep]
                scores, rows = scores[scores >= bar], rows[scores >= bar]
                worst = max(worst, bar)
        best = sorted((-s, i) for s, r in zip(scores.tolist(), rows.tolist(), strict=True) for i in ids[r])[:keep]
        keys += [key] * len(best)
        found_ids += [i for _, i in best]
        found_scores += [-s for s, _ in best]
    return pa.table({"key": pa.array(keys, pa.int64()), "vec_id": pa.array(found_ids, pa.int64()),
                     "score": pa.array(found_scores, pa.float64())})


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5, sure: float = SURE) -> DataFrame:
    """The k nearest rows by cosine of each query row, among all other rows: query_id, rank, vec_id, score.

    Unit vectors are projected by a Gaussian matrix; the squared projected distance of a pair, over its squared distance, is
    chi-square. Once points not yet seen are so far away in projection that a neighbour better than the k-th best would hardly
    project there (probability 1 - sure), a search stops. Rows lie in the cells of a kd-tree over the projections (its upper
    splits from a bounded sample, all rows indexed); a query searches its own cell and then each other cell whose
    box passes the test with what it has. Equal vectors are one entry with their k + 1 smallest ids, and equal queries one search.

    Ties go to the smaller vec_id; fewer rows give fewer neighbours. Vectors that are null, zero, hold a null or non-finite
    component or have another size than most take no part, nor do rows without vec_id; repeated vec_ids are rows of their own, none of
    which is a neighbour of its own id. Other columns are ignored; an empty table gives no row.
    """
    spark, keep = embeddings.sparkSession, k + 1
    rows = embeddings.select(F.col("vec_id").cast("long"), "embedding", is_query.alias("asks")).filter(
        whole() & F.col("vec_id").isNotNull())
    size = common_size(rows)
    result = "query_id long, rank int, vec_id long, score double"
    if not size:
        return spark.createDataFrame([], result)
    rows = rows.filter(F.size("embedding") == size).withColumn("key", F.xxhash64("embedding"))
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).filter(F.col("nth") <= keep)
    entries = stage(few.groupBy("key").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("vector")), "neighbours-entries")
    total = entries.count()
    cells = 1 << max(0, math.ceil(math.log2(max(1, total / CELL_ROWS))))
    plane = np.random.default_rng(SEED).standard_normal((size, PROJECTED))
    sample = entries.orderBy("key").limit(SAMPLE).select("vector").collect()
    splits = kd_cells(unit(np.array([r["vector"] for r in sample], float)) @ plane, cells)
    reach = chi_square_quantile(sure, PROJECTED)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = unit(matrix(batch.column("vector"), size)) @ plane
            flat = pa.array(points.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * PROJECTED), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("ids"), batch.column("vector"), lists, pa.array(cell_of(points, splits))],
                names=["key", "ids", "vector", "point", "cell"])

    kind = entries.schema["vector"].dataType.simpleString()
    index = stage(entries.mapInArrow(
        place, f"key long, ids array<long>, vector {kind}, point array<double>, cell long"), "neighbours-index")
    sides = [agg(F.col("point")[i]).alias(f"{name}{i}") for i in range(PROJECTED) for agg, name in ((F.min, "l"), (F.max, "h"))]
    boxes = index.groupBy("cell").agg(*sides).orderBy("cell").collect()  # one row per cell
    numbers = np.array([b["cell"] for b in boxes])
    low = np.array([[b[f"l{i}"] for i in range(PROJECTED)] for b in boxes])
    high = np.array([[b[f"h{i}"] for i in range(PROJECTED)] for b in boxes])

    asking = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "key")
    blocks = max(1, -(-asking.count() // BLOCK_QUERIES))
    block = F.pmod(F.col("key"), F.lit(blocks))
    stored = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, size, keep, reach)

    def run(asked: DataFrame) -> DataFrame:
        return stage(stored.select("cell", "block", "ids", "vector", "point").groupBy("cell", "block").cogroup(
            asked.select("cell", "block", "key", "vector", "point", "worst").groupBy("cell", "block")).applyInArrow(
            search, "key long, vec_id long, score double"), "neighbours-found")

    once = stage(index.join(asking.select("key").distinct(), "key").withColumns({"block": block, "home": F.col("cell")}), "neighbours-asked")
    at_home = run(once.withColumn("worst", F.lit(-1.0)))
    # What a query has after its own cell: its k-th best other, or nothing to stop at.
    have = at_home.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("s")).select(
        "key", F.when(F.col("n") >= keep, F.col("s")).otherwise(-1.0).alias("worst"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, worst = matrix(batch.column("point"), PROJECTED), batch.column("worst").to_numpy()
            home = batch.column("home").to_numpy()
            for a in range(0, len(points), 1024):
                far = _box_distance(points[a:a + 1024, None, :], low, high)
                go = (far <= reach * (2 - 2 * worst[a:a + 1024, None])) & (numbers != home[a:a + 1024, None])
                row, to = np.nonzero(go)
                part = batch.take(pa.array(row + a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[to]), *(part.column(c) for c in ("block", "key", "vector", "point", "worst"))],
                    names=["cell", "block", "key", "vector", "point", "worst"])

    found = at_home
    if len(boxes) > 1:
        away = once.join(have, "key").select("home", "block", "key", "vector", "point", "worst").mapInArrow(
            route, f"cell long, block long, key long, vector {kind}, point array<double>, worst double")
        found = at_home.unionByName(run(away))
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    lists = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= keep).select("key", "vec_id", "score")
    own = asking.distinct().join(lists, "key").filter("vec_id != query_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
