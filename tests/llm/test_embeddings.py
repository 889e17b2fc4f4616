"""Nearest neighbours and near-duplicate vectors against all pairs."""

import numpy as np
import pytest
from filetrail.llm import near_vectors, neighbours
from filetrail.llm.common import table
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, key string"


def cosines(vectors):
    x = np.array(vectors, np.float32).astype(float)
    n = np.sqrt((x * x).sum(1))
    return (x @ x.T) / np.outer(n, n)


def recall(found, ids, vectors, asks, k):
    scores = cosines(vectors)
    hit = total = 0
    for i in asks:
        others = sorted((-scores[i, j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        got = found.get(ids[i], [])
        assert [r for r, _, _ in got] == list(range(1, len(got) + 1)) and len(got) == min(k, len(others))
        for _, j, s in got:
            assert j != ids[i] and abs(s - scores[i, ids.index(j)]) < 1e-12
        hit += sum(-s <= g[2] + 1e-12 for (s, _), g in zip(others, got, strict=True))
        total += len(others)
    return hit / total


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 300)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 16)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 5)
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    data = rows.orderBy("vec_id").collect()
    ids, vectors = [r.vec_id for r in data], [r.embedding for r in data]
    found = lists(neighbours.nearest(rows, F.col("vec_id") % 50 == 0))
    asks = [i for i, d in enumerate(ids) if d % 50 == 0]
    assert set(found) == {ids[i] for i in asks}
    assert recall(found, ids, vectors, asks, 5) >= 0.9


def test_clustered_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8))
    vectors = [(base[i % 40] + 0.05 * rng.standard_normal(8)).tolist() for i in range(400)] + [base[0].tolist()] * 30
    rows = [(i, v, i % 3, "x") for i, v in enumerate(vectors)]
    odd = [(500, None, 1, "x"), (550, [0.0] * 8, 1, "x"), (600, [1.0, None] + [0.0] * 6, 1, "x"), (650, [float("nan")] * 8, 1, "x"),
           (700, [1.0, 2.0], 1, "x"), (750, [float("inf")] + [0.0] * 7, 1, "x"), (None, [1.0] * 8, 1, "x")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    found = lists(neighbours.nearest(df, F.col("vec_id") % 50 == 0))
    assert recall(found, list(range(430)), vectors, range(0, 430, 50), 5) >= 0.9
    assert [j for _, j, _ in found[400]] == [401, 402, 403, 404, 405]
    few = lists(neighbours.nearest(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0))
    assert len(few[0]) == 2
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(df.filter("vec_id >= 500 and vec_id < 700"), F.col("vec_id") == 0).count() == 0


def brute_links(rows, threshold):
    good = [i for i, (_, v, l, _) in enumerate(rows)
            if v is not None and l is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    scores = cosines([rows[i][1] for i in good])
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, i in enumerate(good):
        for b, j in enumerate(good):
            if i != j and rows[i][2] == rows[j][2] and scores[a, b] >= threshold:
                links[i] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[root(i)] = min(r[0], best.get(root(i), r[0]))
    return sorted((str(r[0]), links[i], str(best.get(root(i)))) for i, r in enumerate(rows))


@pytest.mark.parametrize("spread, block", [(0.02, 2048), (0.1, 16)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, spread, block):
    monkeypatch.setattr(near_vectors, "PER_CELL", 8)
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", block)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((25, 8))
    rows = [(i, np.float32(base[i % 25] + spread * rng.standard_normal(8)).tolist(), i % 2 if i % 9 else None, "x") for i in range(300)]
    rows += [(300 + i, rows[1][1], 1, "x") for i in range(40)] + [(7, rows[8][1], 0, "x"), (None, rows[8][1], 0, "x")]
    rows += [(500, None, 1, "x"), (550, [0.0] * 8, 1, "x"), (600, [1.0, None] + [0.0] * 6, 1, "x"), (700, [1.0, 2.0], 1, "x")]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute_links(rows, 0.98)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_near_vectors_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_vectors.near_duplicates(df).count() == 0
    one = near_vectors.near_duplicates(spark.createDataFrame([(1, None, 1, None), (2, [1.0], None, None)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in one) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.random(7), rng.random(5)
        got = near_vectors.multi_sequence(a, b, 0.9)
        want = sorted((a[i] + b[j], i, j) for i in range(7) for j in range(5) if a[i] + b[j] <= 0.9)
        assert sorted(got) == sorted((i, j) for _, i, j in want)
        assert np.all(np.diff([a[i] + b[j] for i, j in got]) >= 0)


def test_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3
