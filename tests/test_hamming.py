"""Similarity joins lose no pair, whatever the layout."""

import random

import pytest
from filetrail.operators import hamming


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def flipped(rng: random.Random, value: int, bits: int) -> int:
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("radius", [1, 3, 10, 20])
def test_some_band_is_always_within_its_allowance(radius):
    rng = random.Random(radius)
    for bands in range(2, min(radius + 1, 11) + 1):
        made = hamming.layout(radius, bands)
        assert sum(b.width for b in made) == 64
        for _ in range(300):
            difference = flipped(rng, 0, rng.randint(0, radius))
            assert any(((difference >> b.shift) & ((1 << b.width) - 1)).bit_count() <= b.allowance for b in made)


def test_layouts_get_wider_bands_as_sessions_grow():
    steps = hamming.layout_steps(10, (2, 3, 4, 5, 6, 8, 11))
    assert steps[0][1] == hamming.WHOLE_GROUP
    assert [len(b) for _, b in steps[1:]] == sorted((len(b) for _, b in steps[1:]), reverse=True)
    assert all(b.keys(True) <= hamming.MAX_MASKS for _, bands in steps for b in bands)


@pytest.mark.parametrize("bands", [None, 2, 4, 11])
def test_pairs_equal_brute_force(spark, bands):
    if bands == 2:
        radius = 4
    else:
        radius = 10
    rng = random.Random(7)
    centers = [rng.getrandbits(64) for _ in range(12)]
    values = [(s, n, flipped(rng, rng.choice(centers), rng.randint(0, 8))) for n, s in
              enumerate("a" * 90 + "b" * 40 + "c" * 3)]
    values += [("a", 1000 + n, values[0][2]) for n in range(40)]  # copies of one value
    df = spark.createDataFrame([(s, n, signed(v)) for s, n, v in values] + [("a", 5000, None)], "s string, n long, h long")
    got = {(r.s, r.h, r.near): (r.distance, r.copies, r.near_copies)
           for r in hamming.hamming_join(df, "s", "n", "h", radius, bands=bands).collect()}
    first, copies = {}, {}
    for s, n, v in values:
        first[s, v] = min(n, first.get((s, v), n))
        copies[s, v] = copies.get((s, v), 0) + 1
    want = {}
    for s, v in first:
        for t, w in first:
            d = (v ^ w).bit_count()
            if s == t and first[t, w] < first[s, v] and d <= radius:
                want[s, signed(v), signed(w)] = (d, copies[s, v], copies[t, w])
    assert got == want and len(want) > 50
