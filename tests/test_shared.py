"""Texts that share word sequences against brute force."""

import random

import numpy as np
from filetrail.operators import shared
from filetrail.operators.shared import shared_shingle_match


def brute(texts, least, words):
    first, copies = {}, {}
    for i, t in texts:
        first[t] = min(first.get(t, i), i)
        copies[first[t]] = 0
    for _, t in texts:
        copies[first[t]] += 1
    sets = {i: {" ".join(t.split(" ")[k:k + words]) for k in range(len(t.split(" ")) - words + 1)} for t, i in first.items()}
    return {(a, b, copies[a], copies[b], len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}


def made_texts(rng, count):
    new = lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]
    passages = [new(n) for n in (9, 14, 28, 29, 30, 60)]
    texts = []
    for i in range(count):
        parts = [p for p in passages if rng.random() < 0.25]
        text = [w for p in rng.sample(parts, len(parts)) for w in (*new(rng.choice([1, 2, 30])), *p)] + new(rng.choice([0, 5, 200]))
        if i and rng.random() < 0.3:
            text = rng.choice(texts)[1].split(" ")
            if rng.random() < 0.7:
                text[rng.randrange(len(text))] = "changed"
        texts.append((i * 3 + 1, " ".join(text)))
    return texts


def test_equals_brute_force(spark):
    texts = made_texts(random.Random(3), 120)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for least in (25, 1):
        want = brute(texts, least, 5)
        assert len(want) > 100
        rows = shared_shingle_match(df, least, 5).select("doc_id", "other_id", "copies", "other_copies", "shared").collect()
        assert len(rows) == len(want) and set(map(tuple, rows)) == want


def test_pairs_do_not_carry_whole_texts(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [(i, " ".join(f"w{rng.getrandbits(40)}" for _ in range(500)) + (f" {passage}" if i % 2 else "")) for i in range(200)]
    df = session.createDataFrame(texts, "doc_id long, text string")
    before = written()
    assert shared_shingle_match(df, 25, 5).count() == 100 * 99 // 2
    assert written() - before < 100 * 200 * 500


def test_texts_do_not_move_once_per_partner(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    rng = random.Random(5)
    passages = [[f"p{n}x{k}" for k in range(12)] for n in range(80)]
    texts = [(i, " ".join(w for p in passages if rng.random() < 0.5 for w in p)) for i in range(400)]
    df = session.createDataFrame(texts, "doc_id long, text string")
    before = written()
    assert shared_shingle_match(df, 25, 5).count() == 400 * 399 // 2
    moved = written() - before
    assert moved < 6_000_000, moved


def test_blocks_meet_in_every_cell(spark, monkeypatch):
    monkeypatch.setattr(shared, "BLOCK_ENTRIES", 40)
    texts = made_texts(random.Random(6), 80)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = shared_shingle_match(df, 5, 5).select("doc_id", "other_id", "copies", "other_copies", "shared").collect()
    want = brute(texts, 5, 5)
    assert len(rows) == len(want) > 100 and set(map(tuple, rows)) == want


def test_many_partners_are_looked_up_in_pieces(monkeypatch):
    monkeypatch.setattr(shared, "LOOKED_UP", 7)
    rng = random.Random(7)
    sets = [sorted(rng.sample(range(1000, 1030), rng.randint(1, 12))) for _ in range(20)]
    lengths = np.array([len(s) for s in sets])
    families = np.array([f for s in sets for f in s])
    texts = shared._Texts([(np.arange(20), np.ones(20, int), lengths, families, families % 5 + 1)])
    a, b = np.repeat(np.arange(20), 20), np.tile(np.arange(20), 20)
    want = [sum(f % 5 + 1 for f in set(sets[x]) & set(sets[y])) for x, y in zip(a, b, strict=True)]
    assert texts.shared(a, b).tolist() == want
