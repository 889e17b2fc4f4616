"""Streams of arriving files.

Two ways to match them. `stream_match` keeps the live files of every fingerprint value in levelled tables and matches a micro-batch
against what it touches there and against itself with the batch operators. `stateful_match` keeps the fingerprints in operator state,
sharded by session and fingerprint band, for short triggers. `stream_lineage` goes on from matches to verdicts, results and the
depths of a growing graph in one stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from filetrail.functions.fingerprints import hamming
from filetrail.operators.hamming import band_table, layout
from filetrail.operators.lineage import KEY, ROOT_ORDER, depths, session_edges, session_nodes, settled
from filetrail.operators.matching import MATCH_DISTANCE, best_match
from filetrail.operators.ordered import upsert_latest
from filetrail.sources.files import FILE_SCHEMA, MAX_BYTES, limited
from filetrail.session import stage
from filetrail.sources.results import bucket
from filetrail.streaming.levels import Levels

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_files(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files landing in a directory, as a stream of (path, modificationTime, length, content, filename).

    Files over the limit come without their bytes, as in `scan_files`.
    """
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return limited(reader.load(path), max_bytes).withColumn("filename", F.substring_index("path", "/", -1))


def run_available(stream: DataFrame, absorb: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that is there with a foreachBatch sink, then stop."""
    writer = stream.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint)
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    return running


def _store(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write one batch's rows under its own partitions; a repeated batch replaces itself."""
    rows.withColumns({"session_bucket": bucket(), "batch": F.lit(batch_id).cast("bigint")}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("session_bucket", "batch").parquet(path)


# --- stored live files -----------------------------------------------------------------------------------------

VALUE = ["session_id", "rank", "h"]


def _fields(names: str) -> T.StructType:
    """A schema from names; those without a type are strings."""
    types = {"": T.StringType(), "int": T.IntegerType(), "long": T.LongType()}
    return T.StructType([T.StructField(n.partition(":")[0], types[n.partition(":")[2]]) for n in names.split()])


LIVE = _fields("session_id rank:int h:long file_id arrival:long")
BAND_KEYS = _fields("session_id rank:int band:int band_key:long h:long")
STREAM_BANDS, STATE_BANDS = 4, 11  # of the index in tables; of the state, where each key is a row and a part of a shard


def _slots(hashes: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("rank"), F.col(h).alias("h")) for i, h in enumerate(hashes)])


def _listed(uploads: DataFrame, hashes: list[str]) -> DataFrame:
    """One row per upload and fingerprint that it has."""
    return uploads.select("session_id", "arrival", "file_id", F.explode(_slots(hashes)).alias("s")).filter(
        "s.h is not null").select("session_id", "arrival", "file_id", "s.rank", "s.h")


class LiveFiles:
    """The live files of every fingerprint value, and an index of the values by band, as levelled runs.

    A later upload of a file replaces its earlier one as a candidate, so per value and file only the latest upload is kept: that is
    what the value's head, a step function of time, still depends on. Values are listed under the band keys of the stored side
    of the exact layout, so a new value finds all others within the radius by reading the buckets of its own keys.
    """

    def __init__(self, path: str, hashes: list[str], radius: int, bands: int = STREAM_BANDS, **levels):
        self.hashes, self.radius, self.steps = hashes, radius, [(1, layout(radius, min(bands, radius + 1)))]
        latest = lambda rows: rows.groupBy(*VALUE, "file_id").agg(F.max("arrival").alias("arrival"))
        self.live = Levels(f"{path}/live", tuple(VALUE), latest, **levels)
        self.index = Levels(f"{path}/index", ("session_id", "rank", "band", "band_key"), lambda rows: rows.distinct(), **levels)

    def _keys(self, values: DataFrame, searched: bool) -> DataFrame:
        table = band_table(values.sparkSession, self.steps, searched)
        key = F.expr("(shiftrightunsigned(h, shift) & keep) ^ mask").alias("band_key")
        return values.withColumn("layout", F.lit(0)).join(F.broadcast(table), "layout").select(
            "session_id", "rank", "band", key, "h")

    def _stored_near(self, values: DataFrame, asked: DataFrame, reach: int, batch: int) -> DataFrame:
        """(session_id, rank, h, near): stored values within `reach` of the values, met under the asked keys."""
        spark = values.sparkSession
        there = self.index.read(spark, batch, BAND_KEYS, self.index.touched(asked)).withColumnRenamed("h", "near")
        return asked.join(there, ["session_id", "rank", "band", "band_key"]).filter(
            hamming(F.col("h"), F.col("near")) <= reach).select(*VALUE, "near").distinct()

    def history(self, fresh: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
        """(candidates, new values): live files of earlier batches that an upload of this one can have for a parent.

        An upload whose value is stored has a parent at distance 0, so only values that are new search further. What is read are the
        buckets of the batch's values, of the keys of its new ones, and of the values found.
        """
        spark = fresh.sparkSession
        values = stage(_listed(fresh, self.hashes).select(*VALUE).distinct(), "batch-values")
        own = self._keys(values, searched=False).filter("band = 0 and band_key = (h & %d)" % ((1 << self.steps[0][1][0].width) - 1))
        known = stage(self._stored_near(values, own, 0, batch).select(*VALUE), "batch-known")
        new = stage(values.join(known, VALUE, "left_anti"), "batch-new")
        near = self._stored_near(new, self._keys(new, searched=True), self.radius, batch)
        wanted = stage(known.unionByName(near.select("session_id", "rank", F.col("near").alias("h"))).distinct(), "batch-wanted")
        rows = self.live.read(spark, batch, LIVE, self.live.touched(wanted)).join(wanted, VALUE, "left_semi")
        columns = [F.max(F.when(F.col("rank") == i, F.col("h"))).alias(h) for i, h in enumerate(self.hashes)]
        return rows.groupBy("session_id", "file_id").agg(F.max("arrival").alias("arrival"), *columns), new

    def absorb(self, fresh: DataFrame, new: DataFrame, batch: int) -> None:
        self.live.append(self.live.fold(_listed(fresh, self.hashes).select(LIVE.names)), batch)
        self.index.append(self._keys(new, searched=False).select(BAND_KEYS.names), batch)

    def compact(self, spark: SparkSession, batch: int) -> None:
        self.live.compact(spark, batch, LIVE)
        self.index.compact(spark, batch, BAND_KEYS)


def match_batches(path: str, hashes: list[str], radius: int = MATCH_DISTANCE, **levels) -> Callable[[DataFrame, int], DataFrame]:
    """A foreachBatch function: uploads in, `<path>/matches` out; it also returns the batch's matches.

    A batch meets its own uploads and the live files of the values it touches, never the history of a session. Uploads of a session
    come in the order of batches; one that comes later than that sees the files whose latest upload is older than itself.
    Everything is keyed by the batch id, so a batch that is replayed after a failure gives the same tables.
    """
    store = LiveFiles(path, hashes, radius, **levels)

    def absorb(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        fresh = stage(batch.select("session_id", "arrival", "file_id", *hashes), "batch-uploads")
        store.compact(spark, batch_id)
        candidates, new = store.history(fresh, batch_id)
        marked = stage(candidates.select(fresh.columns).withColumn("searching", F.lit(False)).unionByName(
            fresh.withColumn("searching", F.lit(True))), "batch-candidates")
        matches = stage(best_match(marked, hashes, radius, searching="searching"), "batch-matches")
        _store(matches, batch_id, f"{path}/matches")
        store.absorb(fresh, new, batch_id)
        return matches

    return absorb


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/matches").drop("session_bucket", "batch")


def stream_match(
    uploads: DataFrame, path: str, hashes: list[str], checkpoint: str, radius: int = MATCH_DISTANCE, **levels
) -> StreamingQuery:
    return run_available(uploads, match_batches(path, hashes, radius, **levels), checkpoint)


# --- state in the operator -------------------------------------------------------------------------------------

CANDIDATES = "session_id string, arrival bigint, rank int, distance int, parent_order bigint, parent_file_id string"


ASKS, BOTH = 1, 2  # what an upload does under a key: it asks, or it asks and then is stored; 0: it is stored
CHUNKS = 32  # of a shard's values
FEW_CHUNKS = 8  # that a trigger reads one by one
COMPARED = 1 << 21  # distances at a time


class _Shard(StatefulProcessor):
    """The files of one (session, fingerprint, band, band value), queued per value by their latest upload.

    The head of a value is the front of its queue; an upload moves its file to the back. Queues are kept in a fixed number of chunks by a hash of the
    value, so a trigger costs one read and one write per chunk that it touches, however many uploads it brings. Uploads whose value has a head need
    their own chunk only; values seen for the first time are compared with the shard's other values in arrays, once per trigger.
    """

    def __init__(self, radius: int, ttl_ms: int | None):
        self.radius, self.ttl_ms = radius, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "chunk int", "files string")  # lists of values, files, arrivals and times seen, as JSON

    def _begin(self) -> None:
        self.queues: dict[int, dict[str, tuple[int, int]]] = {}  # of the chunks that were read: value, file, (arrival, seen)
        self.read, self.changed = set(), set()

    def _chunk(self, h: int) -> int:
        return (h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) * CHUNKS >> 64

    def _take(self, files: str) -> None:
        for h, file, arrival, seen in zip(*json.loads(files), strict=True):
            self.queues.setdefault(h, {})[file] = (arrival, seen)

    def _read(self, chunks: set[int] | None = None) -> None:
        """Read these chunks, or all, as far as they were not read."""
        if chunks is None or len(chunks) > FEW_CHUNKS:
            if len(self.read) < CHUNKS:
                for (chunk,), (files,) in self.chunks.iterator():
                    if chunk not in self.read:
                        self._take(files)
                self.read.update(range(CHUNKS))
            return
        for chunk in chunks - self.read:
            if self.chunks.containsKey((chunk,)):
                self._take(self.chunks.getValue((chunk,))[0])
            self.read.add(chunk)

    def _write(self) -> None:
        held = {chunk: [] for chunk in self.changed}
        for h, queue in self.queues.items():
            if (rows := held.get(self._chunk(h))) is not None:
                rows.extend((h, file, arrival, seen) for file, (arrival, seen) in queue.items())
        for chunk, rows in held.items():
            if rows:
                self.chunks.updateValue((chunk,), (json.dumps(list(zip(*rows, strict=True))),))
            else:
                self.chunks.removeKey((chunk,))

    def _front(self, h: int) -> tuple[int, str]:
        file, (arrival, _) = next(iter(self.queues[h].items()))
        return arrival, file

    def _near(self, unknown: list[tuple[int, int, int]], fresh: list[int]) -> dict[int, tuple[int, list[int]]]:
        """(least distance, values at it) of values that were unknown when they asked, by their place among the rows.

        `unknown` has places, values and how many of the `fresh` ones, in order of their first upload, were stored by then.
        """
        values = np.array([*self.queues, *fresh], np.int64)
        found, base = {}, len(self.queues)
        if not len(values):
            return found
        places, asked, known = (np.array(c, np.int64) for c in zip(*unknown, strict=True))
        step = max(1, COMPARED // len(values))
        for i in range(0, len(places), step):
            before = known[i:i + step]
            there = values[:base + before[-1]]
            if not len(there):
                continue
            distances = np.bitwise_count((there ^ asked[i:i + step, None]).view(np.uint64))
            distances[:, base:][np.arange(len(there) - base) >= before[:, None]] = 255
            least = distances.min(1)
            for row in np.flatnonzero(least <= self.radius).tolist():
                found[int(places[i + row])] = (int(least[row]), there[distances[row] == least[row]].tolist())
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, rank = key[0], key[1]
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        if self.ttl_ms and not list(self.handle.listTimers()):
            self.handle.registerTimer(now + self.ttl_ms)
        columns = ("arrival", "asks", "file_id", "h")
        arriving = [row for frame in rows for row in zip(*(frame[c].tolist() for c in columns), strict=True)]
        arriving.sort(key=lambda row: (row[0], not row[1]))  # an upload asks before it is stored
        self._begin()
        self._read({self._chunk(row[3]) for row in arriving})
        unknown, fresh = [], {}
        for n, (_, asks, _, h) in enumerate(arriving):
            if h not in self.queues and h not in fresh:
                if asks:
                    unknown.append((n, h, len(fresh)))
                if asks != ASKS:
                    fresh[h] = None
        near = {}
        if unknown:
            self._read()
            near = self._near(unknown, list(fresh))
        found = []
        for n, (arrival, asks, file, h) in enumerate(arriving):
            if asks and n in near:
                distance, values = near[n]
                found.append((session, arrival, rank, distance, *min(map(self._front, values))))
            elif asks and h in self.queues:
                found.append((session, arrival, rank, 0, *self._front(h)))
            if asks != ASKS:
                queue = self.queues.setdefault(h, {})
                queue.pop(file, None)
                queue[file] = (arrival, now)
                self.changed.add(self._chunk(h))
        self._write()
        if found:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Drop files last seen longer ago than they live."""
        now, oldest = timerValues.getCurrentProcessingTimeInMs(), None
        self._begin()
        self._read()
        for h, queue in list(self.queues.items()):
            living = {file: (arrival, seen) for file, (arrival, seen) in queue.items() if seen + self.ttl_ms > now}
            if len(living) < len(queue):
                self.queues[h] = living
                self.changed.add(self._chunk(h))
            oldest = min([*(seen for _, seen in living.values()), *([] if oldest is None else [oldest])], default=None)
        self._write()
        if oldest is not None:
            self.handle.registerTimer(oldest + self.ttl_ms)
        yield pd.DataFrame([], columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """RocksDB for the queries that start inside, whatever the session is set to; a query keeps the store it started with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stateful_candidates(
    uploads: DataFrame, hashes: list[str], radius: int = MATCH_DISTANCE, bands: int = STATE_BANDS,
    ttl_ms: int | None = None,
) -> DataFrame:
    """Candidate parents of a stream of uploads; the best of an upload's rows is its parent.

    Sharded like the batch join: an upload asks under the keys of the searched side and is stored under those of the
    other side, so it meets every candidate within the radius in at least one shard; a key of both sides is one row. One band more than the radius
    lists one key per band, so a session has few shards (about 600 at radius 10), and calls do not grow with the uploads; fewer, wider bands make shards of fewer values out
    of more keys. State is kept per shard, never per session; with `ttl_ms` a file goes when it was not uploaded for so long. The query must start inside `state_store`, or in a session that uses the RocksDB state store.
    """
    spark = uploads.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}, as state_store and build_session do")
    steps = [(1, layout(radius, min(bands, radius + 1)))]
    listed_by = band_table(spark, steps, searched=True).withColumn("asks", F.lit(ASKS)).unionByName(
        band_table(spark, steps, searched=False).withColumn("asks", F.lit(0)))
    keys = listed_by.groupBy("layout", "band", "shift", "keep", "mask").agg(
        F.when(F.count("*") > 1, BOTH).otherwise(F.max("asks")).alias("asks"))
    listed = _listed(uploads, hashes).withColumn("layout", F.lit(0))
    shards = listed.join(F.broadcast(keys), "layout").select(
        "session_id", "rank", "band", F.expr("(shiftrightunsigned(h, shift) & keep) ^ mask").alias("band_value"),
        "arrival", "file_id", "h", "asks")
    return shards.groupBy("session_id", "rank", "band", "band_value").transformWithStateInPandas(
        _Shard(radius, ttl_ms), CANDIDATES, "append", "ProcessingTime" if ttl_ms else "None")


def stateful_match(
    uploads: DataFrame, path: str, hashes: list[str], checkpoint: str, radius: int = MATCH_DISTANCE, **options
) -> StreamingQuery:
    """Matches of a stream of uploads, from operator state, into `<path>/matches`."""
    names = F.array(*[F.lit(h) for h in hashes])

    def absorb(batch: DataFrame, batch_id: int) -> None:
        choice = F.struct("distance", "parent_order", "rank", "parent_file_id")
        best = batch.groupBy("session_id", "arrival").agg(F.min(choice).alias("b"))
        _store(best.select(
            "session_id", "arrival", "b.parent_file_id", "b.parent_order", F.col("b.distance").alias("metric"),
            F.get(names, F.col("b.rank")).alias("match_type"),
        ), batch_id, f"{path}/matches")

    with state_store(uploads.sparkSession):
        return run_available(stateful_candidates(uploads, hashes, radius, **options), absorb, checkpoint)


# --- a growing graph -------------------------------------------------------------------------------------------

def graph_batches(path: str, judge: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends result rows; `judge` turns a batch into rows of the results table."""
    def absorb(batch: DataFrame, batch_id: int) -> None:
        _store(judge(batch), batch_id, f"{path}/results")

    return absorb


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges as of now: the latest upload of every file counts."""
    rows = upsert_latest(
        spark.read.parquet(f"{path}/results").drop("session_bucket", "batch"), ["session_id", "file_id"], "arrival")
    return session_nodes(rows), session_edges(rows)


def incremental_graph(results: DataFrame, path: str, checkpoint: str, judge=lambda batch: batch) -> StreamingQuery:
    return run_available(results, graph_batches(path, judge), checkpoint)


# --- from uploads to the graph in one stream -------------------------------------------------------------------

DEPTHS = _fields("session_id file_id arrival:long up start:long depth:long version:long")
CHILDREN = _fields("session_id up file_id")


class GrowingLineage:
    """Start and depth of every node, brought up to date with the edges of each batch.

    New files and files uploaded again take new parents. What hangs below a file that was uploaded again changes with it and is found
    child by child through an index, one round per edge of height. For all of these, starts and depths settle by pointer doubling among
    themselves; parents outside of them keep their values and end the walk. Nothing else is read or written.
    """

    def __init__(self, path: str, **levels):
        latest = lambda rows: upsert_latest(rows, KEY, "version").select(DEPTHS.names)
        self.nodes = Levels(f"{path}/depths", tuple(KEY), latest, **levels)
        self.children = Levels(f"{path}/children", ("session_id", "up"), lambda rows: rows.distinct(), **levels)

    def _of(self, files: DataFrame, batch: int) -> DataFrame:
        """Nodes of these files (session_id, file_id) as of the batches before."""
        rows = self.nodes.read(files.sparkSession, batch, DEPTHS, self.nodes.touched(files))
        return rows.join(files.select(*KEY).distinct(), KEY, "left_semi")

    def _below(self, top: DataFrame, batch: int) -> DataFrame:
        """Nodes that hang below these, as (session_id, file_id, arrival, up), without those given."""
        spark = top.sparkSession
        seen, edge = top.select(*KEY), top.select(*KEY)
        found = None
        while True:
            over = edge.select("session_id", F.col("file_id").alias("up"))
            listed = self.children.read(spark, batch, CHILDREN, self.children.touched(over)).join(over, ["session_id", "up"], "left_semi")
            files = stage(listed.join(seen, KEY, "left_anti"), "lineage-children")
            # A child that took another parent since is still listed under the old one.
            rows = self._of(files, batch).join(files, [*KEY, "up"], "left_semi").select(*KEY, "arrival", "up")
            edge = stage(rows, "lineage-edge")
            if edge.isEmpty():
                return found if found is not None else edge
            found = edge if found is None else found.unionByName(edge)
            seen = seen.unionByName(edge.select(*KEY))

    def absorb(self, rows: DataFrame, batch: int) -> None:
        """`rows`: session_id, file_id, arrival and up (the parent's file or NULL), one row per file of the batch."""
        spark = rows.sparkSession
        self.nodes.compact(spark, batch, DEPTHS)
        self.children.compact(spark, batch, CHILDREN)
        fresh = stage(rows.select(*KEY, "arrival", "up"), "lineage-fresh")
        again = stage(self._of(fresh, batch), "lineage-again")
        below = self._below(again, batch).join(fresh.select(*KEY), KEY, "left_anti")
        changed = stage(fresh.unionByName(below), "lineage-changed")
        parents = changed.filter("up is not null").select("session_id", F.col("up").alias("file_id")).distinct().join(
            changed.select(*KEY), KEY, "left_anti")
        is_root = F.col("up").isNull()
        moving = changed.select(
            *KEY, F.coalesce("up", "file_id").alias("up"), F.when(is_root, 0).otherwise(1).cast("bigint").alias("jump"),
            F.when(is_root, ROOT_ORDER).otherwise(F.col("arrival")).alias("start"), F.lit(0).cast("bigint").alias("depth"))
        still = self._of(stage(parents, "lineage-parents"), batch).select(
            *KEY, F.col("file_id").alias("up"), F.lit(0).cast("bigint").alias("jump"), "start", "depth")
        state = settled(moving.unionByName(still))
        done = changed.join(state.select(*KEY, "start", "depth"), KEY).withColumn("version", F.lit(batch).cast("bigint"))
        self.nodes.append(done.select(DEPTHS.names), batch)
        self.children.append(fresh.filter("up is not null and up != file_id").select(CHILDREN.names), batch)


def lineage_batches(
    path: str, hashes: list[str], judge: Callable[[DataFrame], DataFrame], kept: list[str], radius: int = MATCH_DISTANCE, **levels,
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: uploads in, matches, results and lineage out.

    `judge` takes the batch's uploads with parent_file_id, parent_order, metric, match_type and parent_<name> of the columns `kept`, and returns
    rows of the results table that have these columns too. A parent's columns come from its file's latest result or from the batch itself.
    """
    match = match_batches(path, hashes, radius, **levels)
    lineage = GrowingLineage(path, **levels)

    def absorb(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        uploads = stage(batch, "lineage-uploads")
        matches = match(uploads, batch_id)
        parents = matches.select("session_id", F.col("parent_file_id").alias("file_id")).distinct()
        columns = ["session_id", "file_id", "arrival", *kept]
        schema = uploads.select(columns).schema
        files = Levels(f"{path}/files", tuple(KEY), lambda rows: upsert_latest(rows, KEY, "arrival").select(columns), **levels)
        files.compact(spark, batch_id, schema)
        stored = files.read(spark, batch_id, schema, files.touched(parents)).join(parents, KEY, "left_semi")
        known = stored.unionByName(uploads.select(columns)).select(
            "session_id", F.col("arrival").alias("parent_order"), *(F.col(c).alias(f"parent_{c}") for c in kept))
        rows = uploads.join(matches, ["session_id", "arrival"], "left").join(known, ["session_id", "parent_order"], "left")
        judged = stage(judge(rows), "lineage-judged")
        _store(judged, batch_id, f"{path}/results")
        latest = stage(upsert_latest(judged, KEY, "arrival"), "lineage-latest")
        files.append(files.fold(uploads.select(columns)), batch_id)
        lineage.absorb(latest.select(*KEY, "arrival", F.col("parent_file_id").alias("up")), batch_id)

    return absorb


def stream_lineage(uploads: DataFrame, path: str, hashes: list[str], judge, kept: list[str], checkpoint: str, **options) -> StreamingQuery:
    return run_available(uploads, lineage_batches(path, hashes, judge, kept, **options), checkpoint)


def read_depths(spark: SparkSession, path: str, before: int = 1 << 60) -> DataFrame:
    """(session_id, file_id, depth) as of now, in the form of `lineage_depth`."""
    return depths(GrowingLineage(path).nodes.read(spark, before, DEPTHS))
