"""Ordered scans over blocks against plain loops."""

import random

import pytest
from filetrail.operators import matching, ordered
from pyspark.sql import functions as F


@pytest.mark.parametrize("how, reverse", [("max", False), ("min", True), ("sum", False), ("sum", True)])
def test_prefixes_do_not_depend_on_blocks(spark, how, reverse):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), t, rng.choice([None, rng.randint(-50, 50)])) for t in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    fold = {"max": max, "min": min, "sum": sum}[how]
    want = {}
    for k, t, _ in rows:
        seen = [v for j, u, v in rows if j == k and v is not None and (u > t if reverse else u < t)]
        want[t] = fold(seen) if seen or how == "sum" else None
    for size in (1, 4, 1000):
        got = ordered.exclusive_prefix(df, ["k"], [F.col("t")], F.col("v"), "p", how, reverse, size)
        assert {r.t: r.p for r in got.collect()} == want


def test_many_small_groups_and_groups_that_fill_blocks(spark):
    rng = random.Random(8)
    rows = [(g, i, rng.randint(-9, 9)) for g in range(60) for i in range(rng.choice([1, 1, 2, 5, 5, 10, 31]))]
    df = spark.createDataFrame(rows, "k long, t long, v long").repartition(5)
    want = {(k, t): sum(v for j, u, v in rows if j == k and u < t) for k, t, _ in rows}
    got = ordered.exclusive_prefix(df, ["k"], [F.col("t")], F.col("v"), "p", "sum", block_rows=5)
    assert {(r.k, r.t): r.p for r in got.collect()} == want
    assert ordered.exclusive_prefix(df.limit(0), ["k"], [F.col("t")], F.col("v"), "p").count() == 0


def test_one_order_value_in_a_third_of_all_rows_does_not_widen_a_block(spark):
    df = spark.range(30_000).select(F.lit("hot").alias("k"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("t"), "id")
    blocked = ordered.in_blocks(df, ["k"], [F.col("t"), F.col("id")], 512)
    assert blocked.groupBy("__block").count().agg(F.max("count")).first()[0] <= 512
    placed = ordered.ordinal(df, ["k"], [F.col("t"), F.col("id")], "n", 512)
    assert placed.select("n").distinct().count() == 30_000
    same = placed.filter("t = 7").agg(F.min("n"), F.max("n"), F.count("*")).first()
    assert same[1] - same[0] + 1 == same[2] >= 10_000


def test_lives_with_microseconds_as_arrivals(spark):
    start = 1_770_000_000_000_000
    rows = [("s", start + 3 * i, f"f{i % 50}") for i in range(400)]
    df = spark.createDataFrame(rows, "session_id string, arrival long, file_id string")
    lives = {r.arrival: (r.replaced_at, r.candidates) for r in matching.prior_candidates(df, block_rows=16).collect()}
    assert lives == {a: (a + 150 if a + 150 <= rows[-1][1] else None, min(i, 50)) for i, (_, a, _) in enumerate(rows)}


def test_latest_row_wins_and_position_counts_from_zero(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 5, None)], "k string, t long, v string")
    assert sorted(map(tuple, ordered.upsert_latest(df, ["k"], "t").collect())) == [("a", 3, "z"), ("b", 5, None)]
    placed = ordered.ordinal(df, ["k"], [F.col("t")], "n", 2)
    assert {(r.k, r.t): r.n for r in placed.collect()} == {("a", 1): 0, ("a", 2): 1, ("a", 3): 2, ("b", 5): 0}
