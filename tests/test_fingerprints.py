"""Fingerprints of texts against brute force."""

import hashlib
import random

from filetrail.functions import fingerprints
from filetrail.functions.fingerprints import simhash64


def brute(text, width):
    words = text.split(" ")
    grams = {" ".join(words[i:i + width]) for i in range(len(words) - width + 1)}
    hashes = [int(hashlib.md5(g.encode()).hexdigest()[:16], 16) for g in grams]
    bits = sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes))
    return (bits - (1 << 64) if bits >= 1 << 63 else bits) if hashes else None


def test_equals_brute_force_and_moves_no_shingle(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "VOTES", 7)  # hashes are counted in several pieces
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "bé", "c\n", "", "d"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 20, 200)]
    rows = [*enumerate([*texts, None, "one two", "  ", "   "]), (3, texts[3])]  # a repeated row stays
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for width in (1, 3):
        marks = simhash64(df, ["doc_id"], "text", width)
        plan = marks._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan
        want = [(i, None if t is None else brute(t, width)) for i, t in rows]
        assert sorted(map(tuple, marks.collect()), key=str) == sorted(want, key=str)
