"""Streams against the step-by-step simulation of uploads."""

import random
from pathlib import Path

import pytest
from filetrail.operators.lineage import lineage_depth
from filetrail.operators.matching import attach_parent, best_match
from filetrail.operators.ordered import upsert_latest
from filetrail.streaming import streams
from filetrail.streaming.levels import Levels
from pyspark.sql import functions as F

from test_hamming import signed
from test_matching import random_uploads, simulate

SCHEMA = "session_id string, arrival long, file_id string, phash long, dhash long"


def frame(spark, uploads):
    return spark.createDataFrame(
        [(s, a, f, *[None if h is None else signed(h) for h in hs]) for s, a, f, hs, _ in uploads], SCHEMA)


def found(rows):
    return {(r.session_id, r.arrival): (r.parent_file_id, r.parent_order, r.metric, r.match_type) for r in rows}


@pytest.mark.parametrize("bands", [11, 4])
def test_state_shards_find_every_parent(spark, tmp_path, bands):
    uploads = [(s, a, f, hs, True) for s, a, f, hs, _ in random_uploads(random.Random(5), 60)]
    for part in (uploads[:25], uploads[25:]):
        frame(spark, part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        streams.stateful_match(stream, str(tmp_path / "out"), ["phash", "dhash"], str(tmp_path / "cp"), bands=bands)
    got = found(streams.read_matches(spark, str(tmp_path / "out")).collect())
    assert got == simulate(uploads, 10) and len(got) > 20


class FakeMap:
    """A map state that counts what is read."""

    def __init__(self):
        self.rows, self.reads = {}, 0

    def getValue(self, key):
        self.reads += 1
        return self.rows[key]

    def containsKey(self, key):
        self.reads += 1
        return key in self.rows

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def iterator(self):
        self.reads += len(self.rows)
        return iter(list(self.rows.items()))


class FakeHandle:
    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, FakeMap())

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def reads(self):
        return sum(m.reads for m in self.maps.values())


class FakeTime:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def shard(radius=10, ttl_ms=None):
    made, handle = streams._Shard(radius, ttl_ms), FakeHandle()
    made.init(handle)
    return made, handle


def trigger(made, rows, now=0):
    frame = __import__("pandas").DataFrame(rows, columns=["file_id", "arrival", "h", "asks"])
    return [tuple(r) for out in made.handleInputRows(("s", 0), iter([frame]), FakeTime(now)) for r in out.itertuples(index=False)]


def test_reads_of_a_trigger_grow_with_its_rows_not_with_the_shard():
    made, handle = shard()
    trigger(made, [(f"f{i}", i, 77, False) for i in range(3000)])
    before = handle.reads()
    assert trigger(made, [("f0", 5000, 77, True), ("f0", 5000, 77, False), ("g", 5001, 77, True), ("g", 5001, 77, False)]) == [
        ("s", 5000, 0, 0, 0, "f0"), ("s", 5001, 0, 0, 1, "f1")]
    assert handle.reads() - before < 40
    before = handle.reads()
    assert trigger(made, [("n", 6000, 76, True)]) == [("s", 6000, 0, 1, 1, "f1")]  # one entry for the one value
    assert handle.reads() - before < 5


def test_queues_equal_a_simulation_and_expire():
    rng = random.Random(2)
    made, _ = shard()
    values, stored = [rng.getrandbits(12) for _ in range(9)], {}
    for at in range(0, 400, 5):
        rows, want = [], []
        for a in range(at, at + 5):
            n = rng.randrange(40)
            file, h = f"f{n}", values[n % 9]
            rows += [(file, a, h, True), (file, a, h, False)]
            best = min(((v ^ h).bit_count(), o, f) for f, (o, v) in stored.items()) if stored else None
            if best and best[0] <= 10:
                want.append(("s", a, 0, *best))
            stored[file] = (a, h)
        assert trigger(made, rows) == want
    aging, handle = shard(ttl_ms=100)
    trigger(aging, [("a", 1, 5, False), ("b", 2, 5, False), ("c", 3, 6, False)], now=1000)
    trigger(aging, [("a", 4, 5, False)], now=1050)
    assert handle.timers == [1100]
    list(aging.handleExpiredTimer(("s", 0), FakeTime(1100), None))
    assert handle.timers[-1] == 1150 and trigger(aging, [("x", 9, 6, True)], now=1120) == [("s", 9, 0, 2, 4, "a")]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    uploads = [(s, a, f, hs, True) for s, a, f, hs, _ in random_uploads(random.Random(6), 60)]
    df = frame(spark, uploads)
    absorb = streams.match_batches(str(tmp_path), ["phash", "dhash"], fan=2)
    for batch in (0, 1, 1, 2, 3):
        absorb(df.filter(F.col("arrival").between(15 * batch, 15 * batch + 14)), batch)
    rows = streams.read_matches(spark, str(tmp_path)).collect()
    got = found(rows)
    assert got == simulate(uploads, 10) and len(got) == len(rows)


def test_a_batch_opens_only_buckets_of_values_that_it_touches(spark, tmp_path):
    rng = random.Random(4)
    old = [("s", i, f"f{i}", rng.getrandbits(63)) for i in range(200)]
    schema = "session_id string, arrival long, file_id string, phash long"
    absorb = streams.match_batches(str(tmp_path), ["phash"], radius=6)
    absorb(spark.createDataFrame(old, schema), 0)
    store = streams.LiveFiles(str(tmp_path), ["phash"], 6)
    new = [("s", 300, "n1", old[7][3]), ("s", 301, "n2", old[9][3] ^ 0b1011)]
    rows = spark.createDataFrame(new, schema)
    values = streams._listed(rows, ["phash"]).select("session_id", "rank", "h")
    near = values.unionByName(spark.createDataFrame([("s", 0, old[9][3])], "session_id string, rank int, h long"))
    touched = set(store.live.touched(near))
    broken = 0
    for folder in Path(tmp_path, "live", "0-0").glob("bucket=*"):
        if int(folder.name.split("=")[1]) not in touched:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"no parquet")
                file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
                broken += 1
    assert broken > 40
    got = found(absorb(rows, 1).collect())
    assert got == {("s", 300): ("f7", 7, 0, "phash"), ("s", 301): ("f9", 9, 3, "phash")}


def test_levels_merge_and_read_like_one_table(spark, tmp_path):
    fold = lambda rows: rows.groupBy("k").agg(F.max("v").alias("v"))
    levels = Levels(str(tmp_path / "t"), ("k",), fold, fan=3)
    schema = spark.createDataFrame([], "k long, v long").schema
    want = {}
    for batch in range(20):
        levels.compact(spark, batch, schema)
        assert {r.k: r.v for r in levels.read(spark, batch, schema).collect()} == want
        rows = [(k % 7, batch) for k in range(batch, batch + 3)]
        want |= dict(rows)
        levels.append(spark.createDataFrame(rows, schema), batch)
        if batch == 12:
            levels.append(spark.createDataFrame(rows, schema), batch)
    assert len(levels.runs(spark, 20)) <= 2 * 3 and (0, 8) in levels.runs(spark, 20)
    half = Path(tmp_path, "t", "18-20")
    half.mkdir()  # a merge that did not finish does not count
    assert {r.k: r.v for r in levels.read(spark, 20, schema).collect()} == want


def test_depths_after_every_batch_equal_those_of_the_whole_graph(spark, tmp_path):
    uploads = [(s, a, f, hs, True) for s, a, f, hs, _ in random_uploads(random.Random(12), 70)]
    df = frame(spark, uploads).withColumn("filename", F.concat("file_id", F.lit("@"), F.col("arrival").cast("string")))
    seen = []

    def judge(rows):
        return rows.select("session_id", "file_id", "arrival", "filename", "parent_file_id", "parent_order", "parent_filename")

    absorb = streams.lineage_batches(str(tmp_path), ["phash", "dhash"], judge, ["filename"], fan=2)
    for batch, (low, high) in enumerate([(0, 20), (20, 21), (21, 45), (45, 70)]):
        now = df.filter(f"arrival < {high}")
        absorb(now.filter(f"arrival >= {low}"), batch)
        if batch == 2:
            absorb(now.filter(f"arrival >= {low}"), batch)
        rows = upsert_latest(attach_parent(now, best_match(now, ["phash", "dhash"]), ["filename"]), ["session_id", "file_id"], "arrival")
        edges = rows.filter("parent_file_id is not null").select(
            "session_id", F.col("parent_file_id").alias("source"), F.col("file_id").alias("target"))
        want = {(r.session_id, r.file_id): r.depth for r in lineage_depth(rows, edges).collect()}
        got = {(r.session_id, r.file_id): r.depth for r in streams.read_depths(spark, str(tmp_path), batch + 1).collect()}
        assert got == want
        seen.append(max(want.values()))
    assert max(seen) > 1
    stored = spark.read.parquet(str(tmp_path / "results")).collect()
    assert len(stored) == 70
    assert all(r.parent_filename == f"{r.parent_file_id}@{r.parent_order}" for r in stored if r.parent_file_id)


def test_state_match_runs_in_a_session_with_another_state_store(spark, tmp_path):
    plain, key = spark.newSession(), "spark.sql.streaming.stateStore.providerClass"
    plain.conf.set(key, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    before = plain.conf.get(key)
    plain.createDataFrame([("s", 1, "f", 5, 5), ("s", 2, "g", 7, 7)], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = plain.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    streams.stateful_match(stream, str(tmp_path / "out"), ["phash", "dhash"], str(tmp_path / "cp"))
    assert found(streams.read_matches(plain, str(tmp_path / "out")).collect()) == {("s", 2): ("f", 1, 1, "phash")}
    assert plain.conf.get(key) == before


def test_calls_of_a_trigger_do_not_grow_with_its_values():
    made, handle = shard()
    rng = random.Random(9)
    values = [rng.getrandbits(62) for _ in range(4000)]
    written, update = [], FakeMap.updateValue
    for m in handle.maps.values():
        m.updateValue = lambda key, value, m=m: written.append(key) or update(m, key, value)
    for at in (0, 2000):
        some = [(f"f{i}", i, values[i], asks) for i in range(at, at + 2000) for asks in (True, False)]
        assert trigger(made, some) == []
    assert handle.reads() < 200 and len(written) < 200
    assert trigger(made, [("n", 5000, values[3999] ^ 5, True)]) == [("s", 5000, 0, 2, 3999, "f3999")]
