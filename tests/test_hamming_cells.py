"""Values of a session are compared in a grid of cells; no cell holds them all, and no pair is lost."""

import random

from filetrail.operators import hamming
from test_hamming import signed


def test_cells_of_a_grid_lose_no_nearest_pair(spark, monkeypatch):
    monkeypatch.setattr(hamming, "CELL_VALUES", 16)
    monkeypatch.setattr(hamming, "BLOCK_SEARCHED", 5)
    monkeypatch.setattr(hamming, "BLOCK_STORED", 7)
    rng = random.Random(3)
    values = {s: [(n, rng.getrandbits(64)) for n in range(size)] for s, size in (("a", 150), ("b", 20), ("c", 1))}
    rows = [(s, n, signed(v)) for s, own in values.items() for n, v in own]
    asked = spark.createDataFrame(rows, "s string, n long, h long")
    stored = asked.withColumnRenamed("n", "first_n")
    want = {}
    for s, own in values.items():
        for n, v in own:
            near = [(d, signed(w)) for m, w in own if m < n and (d := (v ^ w).bit_count()) <= 26]
            if near:
                want[s, n] = {x for x in near if x[0] == min(near)[0]}
    pairs = hamming.near_values(asked, stored, ["s"], 26, before="n", best=True, largest=150)
    assert pairs.count() < 150 * 149 / 4  # 10 cells a row, each with its nearest ones only
    got = {}
    for r in pairs.collect():
        got.setdefault((r.s, r.n), set()).add((r.distance, r.near))
    assert {k: {x for x in found if x[0] == min(found)[0]} for k, found in got.items()} == want and len(want) > 100
    every = hamming.near_values(asked, stored, ["s"], 26, before="n", largest=150).count()
    assert every == sum((v ^ w).bit_count() <= 26 for own in values.values() for n, v in own for m, w in own if m < n)
