"""The quality classifier by its held-out accuracy, sharding against the law it states."""

import zlib
from collections import Counter, defaultdict

import pytest
from filetrail.llm import quality, sharding
from filetrail.llm.common import table
from filetrail.llm.queries import QUERIES
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.01"


def test_classifier_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in QUERIES["op2_quality"](spark, SF_DIR).collect()}
    assert len(rows) == table(spark, SF_DIR, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    marks = [(r.quality, rows[r.doc_id]) for r in table(spark, SF_DIR, "labels").collect() if rows[r.doc_id].held_out]
    good = [r.predicted for q, r in marks if q == 1]
    bad = [r.predicted for q, r in marks if q == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_classifier_ignores_ids_and_survives_odd_rows(spark):
    train = spark.createDataFrame(
        [(f"good words of plain prose number {i} and more of it " * 9, 1) for i in range(120)]
        + [(f"!!! BUY {i} NOW !!! $$$ " * 20, 0) for i in range(120)] + [(None, 1), ("x", None)], "text string, quality int")
    train = train.withColumn("doc_id", F.xxhash64("text"))
    model = quality.train(train.select("doc_id", "text"), train.select("doc_id", "quality"))
    rows = spark.createDataFrame(
        [(1, None, 9.0), (2, "", 9.0), (None, "good words of plain prose number 7 and more of it " * 9, 9.0), (4, "!!! BUY 7 NOW !!! $$$ " * 30, None),
         (4, "!!! BUY 7 NOW !!! $$$ " * 30, None)], "doc_id long, text string, quality_score double")
    got = quality.score(rows, model).collect()
    assert [r.doc_id for r in got] == [1, 2, None, 4, 4]
    by = [r.quality_score for r in got]
    assert by[0] == by[1] and by[3] == by[4] < 0.3 < by[2]
    assert quality.train(train.limit(0).select("doc_id", "text"), train.select("doc_id", "quality")) is None
    assert {r.quality_score for r in quality.score(rows, None).collect()} == {0.5}


@pytest.fixture
def skewed(spark):
    rows = [(i, f"text {i} " * (i % 37), "x") for i in range(3000)] + [(5000 + i, "copy " * 100, "y") for i in range(1500)]
    rows += [(9000, "w" * 40_000, None), (None, None, None), (7, None, "z"), (7, None, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string").drop("shard").withColumn("bytes", F.lit(1))


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_even_and_slots_gapless(spark, skewed, shards):
    source = skewed.collect()
    got = sharding.shard(skewed, shards).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r.doc_id, size(r.text), zlib.crc32((r.text or "").encode())) for r in source)
    by_shard, slots = Counter(), defaultdict(list)
    for r in got:
        by_shard[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(by_shard.values()) / shards
    assert all(abs(by_shard[s] - mean) <= 0.02 * mean + 40_016 for s in range(shards))
    whole = [s for s in range(shards) if abs(by_shard[s] - mean) <= 0.02 * mean + 1500]
    assert len(whole) >= shards - 4  # only the shards beside the one huge text may be further off
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 1  # only the large group is cut


def test_sharding_of_few_rows(spark, skewed):
    assert sharding.shard(skewed.limit(0)).count() == 0
    got = sharding.shard(skewed.orderBy(F.desc("doc_id")).limit(2)).collect()
    assert len(got) == 2 and all(r.slot in (0, 1) for r in got)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_counting_rounds_are_few(spark, monkeypatch, sf):
    counted, plain = [], sharding._between
    monkeypatch.setattr(sharding, "_between", lambda *args: counted.append(1) or plain(*args))
    docs = table(spark, f"/root/testdata/sf{sf}", "documents")
    got = sharding.shard(docs, 40).groupBy("shard").agg(F.sum("size").alias("n"), F.max("size").alias("most")).collect()
    total, most = sum(r["n"] for r in got), max(r["most"] for r in got)
    assert len(counted) <= 16
    assert all(abs(r["n"] - total / 40) <= max(total / 40 * 0.02, most) + 1 for r in got)


def test_asked_columns_may_be_named_like_inner_ones(spark):
    rows = [(1, "a b", 7, "r", 3, 9), (2, None, 8, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, row string, size long, slice long")
    got = sharding.shard(docs, 2, columns=("key", "row", "size", "slice")).orderBy("doc_id").collect()
    assert [(r.key, r.row, r.own_size, r.slice, r.size) for r in got] == [(7, "r", 3, 9, 19), (8, None, None, 1, 16)]
