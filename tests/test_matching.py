"""The set-based matcher against a step-by-step simulation of uploads with replacement."""

import random
import time

import pytest
from filetrail.operators import matching
from filetrail.operators.features import descriptors_to_rows, local_feature_match
from pyspark.sql import functions as F

from test_hamming import flipped, signed


def simulate(uploads, radius):
    """Uploads one by one: candidates in order of their latest upload, nearest first, then order, then rank."""
    stored, out = {}, {}
    for s, a, f, hashes, asks in sorted(uploads, key=lambda u: u[1]):
        table = stored.setdefault(s, {})
        best = None
        for g, (order, old) in sorted(table.items(), key=lambda kv: kv[1][0]):
            for rank, (x, y) in enumerate(zip(hashes, old)):
                if x is None or y is None:
                    continue
                d = (x ^ y).bit_count()
                if d <= radius and (best is None or d < best[2]):
                    best = (g, order, d, ("phash", "dhash")[rank])
        if asks and best:
            out[s, a] = best
        table.pop(f, None)
        table[f] = (a, hashes)
    return out


def random_uploads(rng, count):
    centers = [rng.getrandbits(64) for _ in range(4)]
    files = []
    for n in range(count // 2):
        hashes = [flipped(rng, rng.choice(centers), rng.choice([0, 0, 1, 3, 7, 20])) for _ in range(2)]
        if rng.random() < 0.2:
            hashes[rng.randint(0, 1)] = None
        files.append((f"f{n}", tuple(hashes)))
    hot = files[0]
    rows = []
    for a in range(count):
        f, hashes = hot if rng.random() < 0.3 else rng.choice(files)
        rows.append(("a" if rng.random() < 0.7 else "b", a, f, hashes, rng.random() < 0.9))
    return rows


@pytest.mark.parametrize("seed, tiers", [(1, ()), (2, (3,)), (3, (1, 3))])
def test_equals_the_sequential_rules(spark, seed, tiers):
    uploads = random_uploads(random.Random(seed), 160)
    df = spark.createDataFrame(
        [(s, a, f, *[None if h is None else signed(h) for h in hs], asks) for s, a, f, hs, asks in uploads],
        "session_id string, arrival long, file_id string, phash long, dhash long, asks boolean")
    rows = matching.hash_matches(df, ["phash", "dhash"], 10, searching="asks", tiers=tiers, block_rows=8).collect()
    got = {(r.session_id, r.arrival): (r.parent_file_id, r.parent_order, r.metric, r.match_type) for r in rows}
    want = simulate(uploads, 10)
    assert got == want
    assert len(got) == len(rows) and any(m[2] > 3 for m in want.values()) and any(m[2] == 0 for m in want.values())


def test_reupload_parents_itself_and_moves_back(spark):
    # g equals f in content hash; f is uploaded three times, so that the earliest live candidate changes.
    df = spark.createDataFrame(
        [("s", 1, "f", 5), ("s", 2, "g", 5), ("s", 3, "f", 5), ("s", 4, "f", 5), ("s", 5, "h", 5), ("t", 6, "h", 5)],
        "session_id string, arrival long, file_id string, phash long")
    got = {r.arrival: (r.parent_file_id, r.parent_order) for r in matching.hash_matches(df, ["phash"]).collect()}
    assert got == {2: ("f", 1), 3: ("f", 1), 4: ("g", 2), 5: ("g", 2)}


def test_candidate_lives_say_who_sees_whom(spark):
    uploads = random_uploads(random.Random(9), 80)
    df = spark.createDataFrame([(s, a, f) for s, a, f, _, _ in uploads], "session_id string, arrival long, file_id string")
    lives = matching.prior_candidates(df, block_rows=8).collect()
    for s, a, f, _, _ in uploads:
        latest = {}
        for t, b, g, _, _ in uploads:
            if t == s and b < a:
                latest[g] = b
        seen = {r.file_id: r.arrival for r in lives if r.session_id == s and r.arrival < a
                and (r.replaced_at is None or a <= r.replaced_at)}
        assert seen == latest
        assert [r.candidates for r in lives if r.arrival == a] == [len(latest)]


@pytest.mark.parametrize("cell_files", [3, 256])
def test_feature_pass_equals_brute_force(spark, cell_files):
    rng = random.Random(4)
    base = [[rng.getrandbits(256) for _ in range(12)] for _ in range(4)]
    files = {}
    for n in range(14):
        picked = base[n % 4][: rng.randint(1, 12)]
        noisy = [d ^ sum(1 << b for b in rng.sample(range(256), rng.choice([0, 2, 5, 60]))) for d in picked]
        files[f"f{n}"] = noisy
    uploads = [("s", a, f"f{rng.randrange(14)}") for a in range(40)]
    features = spark.createDataFrame(
        [("s", f, bytearray(b"".join(d.to_bytes(32, "big") for d in ds))) for f, ds in files.items()],
        "session_id string, file_id string, blob binary")
    df = spark.createDataFrame(uploads, "session_id string, arrival long, file_id string")

    def good(a, b):
        if len(files[a]) < 2 or len(files[b]) < 2:
            return 0
        count = 0
        for q in files[a]:
            d = sorted((q ^ p).bit_count() for p in files[b])
            count += d[0] < 0.75 * d[1]
        return count

    want = {}
    for _, a, f in uploads:
        latest = {}
        for _, b, g in uploads:
            if b < a:
                latest[g] = b
        best = None
        for g, order in sorted(latest.items(), key=lambda kv: kv[1]):
            n = good(f, g)
            if n >= 4 and (best is None or n > best[2]):
                best = (g, order, n)
        if best:
            want[a] = best
    rows = local_feature_match(features, df, min_good=4, block_rows=8, cell_files=cell_files).collect()
    assert {r.arrival: (r.parent_file_id, r.parent_order, r.metric) for r in rows} == want
    assert len(want) > 10


def test_records_of_a_large_blob_do_not_copy_it_each(spark):
    count = 100_000
    blob = F.sequence(F.lit(0), F.lit(count - 1))
    blob = F.unhex(F.array_join(F.transform(blob, lambda i: F.lpad(F.hex(i.cast("bigint")), 64, "0")), ""))
    start = time.time()
    got = descriptors_to_rows(spark.range(1).select(blob.alias("blob")).repartition(1), "blob").agg(
        F.count("*").alias("n"), F.sum((F.conv(F.hex("descriptor"), 16, 10).cast("int") != F.col("kp")).cast("int")).alias("wrong")).first()
    assert (got.n, got.wrong) == (count, 0)
    assert time.time() - start < 20
