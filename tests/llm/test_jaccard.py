"""The Jaccard join against every pair."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest
from filetrail.llm import jaccard, shingles
from filetrail.llm.common import screened, table
from filetrail.llm.components import components
from pyspark.sql import functions as F


def plain_set(text, n):
    found = [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    return {tuple(found[i:i + n]) for i in range(len(found) - n + 1)} if len(found) >= n else ({tuple(found)} if found else set())


def brute(rows, n, threshold):
    sets = [plain_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if a and b and common >= threshold * (len(a) + len(b) - common):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root(i)] = min(d, best.get(root(i), d))
    return sorted((str(d), len(sets[i]), str(best.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 4, 5, 8, 12, 30, 80, 200, 500]))] for _ in range(n)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(rnd.randint(0, 6)):
            c = list(b)
            for _ in range(rnd.randint(0, max(1, len(c) // 50))):
                c[rnd.randrange(len(c))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                c = c[:max(1, int(len(c) * rnd.uniform(0.8, 1)))]
            texts.append(rnd.choice([" ", "\n", "\t \x0b"]).join(c).upper() if rnd.random() < 0.3 else " ".join(c))
    return texts + [None, "", "  \n", "é ü\xa0x", "É ü\xa0x", "a b c"]


@pytest.mark.parametrize("words, threshold", [(4, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_components_equal_brute_force(spark, words, threshold):
    texts = corpus(words, 70)
    random.Random(1).shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5]), (None, "alone here for ever and ever")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("x"), "a": F.lit(1)})
    got = jaccard.link_components(docs, words, threshold).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, words, threshold)
    kept = jaccard.keep_one(docs, words, threshold)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert ids == sorted({r.doc_id for r in got if r.doc_id is not None and r.doc_id == r.component_id})


def test_real_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard.link_components(docs, 4, Fraction(85, 100)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 4, Fraction(85, 100))


def test_similar_sets_share_a_signature():
    rnd = np.random.default_rng(4)
    for threshold in (Fraction(85, 100), Fraction(4, 5), Fraction(1, 2)):
        layout = jaccard.bands(threshold, 5000)
        for size in (6, 7, 13, 40, 100, 333, 1500):
            for _ in range(20):
                a = rnd.integers(0, 2**63, size).astype(np.uint64)
                # As many changes as the threshold allows, some of them additions.
                common = int(rnd.integers(int(np.ceil(float(2 * size * threshold / (1 + threshold)))), size + 1))
                extra = int((common * (1 / threshold) - size)) if common < size else int(size * (1 / threshold - 1))
                b = np.concatenate([a[:common], rnd.integers(0, 2**63, max(0, extra)).astype(np.uint64)])
                if len(b) == size == common or common < threshold * (size + len(b) - common):
                    continue
                both = np.concatenate([np.sort(a), np.sort(b)])
                found, whose = jaccard.signatures(both, np.array([0, len(a), len(a) + len(b)]), layout, threshold,
                                                   np.sort(rnd.choice(a, len(a) // 3)))
                assert set(found[whose == 0]) & set(found[whose == 1])


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(1200):
        c = list(base)
        c[rnd.randrange(150)] = f"x{i}"
        texts.append(" ".join(c))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    assert {r.component_id for r in jaccard.link_components(docs, 4, Fraction(85, 100)).collect()} == {0}


def test_components_of_a_long_chain_and_empty_tables(spark):
    links = spark.createDataFrame([(i * 7 % 101, (i + 1) * 7 % 101) for i in range(100)], "a long, b long")
    assert {r.label for r in components(links).collect()} == {0}
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.link_components(docs).count() == 0 and jaccard.keep_one(docs).count() == 0


def test_shingles_equal_the_definition():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aB c\t\n é\x0b") for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    values, bounds = shingles.shingle_sets(raw, offsets, 4)
    wanted = [plain_set(t, 4) for t in texts]
    assert np.diff(bounds).tolist() == [len(s) for s in wanted]
    names = {}
    for i, s in enumerate(wanted):
        got = set(values[bounds[i]:bounds[i + 1]].tolist())
        names.setdefault(frozenset(s), got)
        assert names[frozenset(s)] == got


def test_near_copies_under_the_threshold_are_not_paired(spark):
    """Copies of one text whose changes come from a short list: every element is shared, few pairs are similar enough."""
    rnd = np.random.default_rng(8)
    threshold = Fraction(85, 100)
    for size, changed in ((60, 7), (400, 45), (3000, 340)):
        base, pool = (rnd.integers(0, 2**63, n).astype(np.uint64) for n in (size, 12 * changed))
        sets = [np.concatenate([rnd.permutation(base)[changed:], rnd.permutation(pool)[:changed]]) for _ in range(60)]
        for i in range(0, 60, 6):  # links between sets of different sizes
            sets.append(np.append(sets[i], rnd.integers(0, 2**63, int(size * 0.1)).astype(np.uint64)))
        similar = {(a, b) for b in range(len(sets)) for a in range(b) for common in [len(np.intersect1d(sets[a], sets[b]))]
                   if common >= threshold * (len(sets[a]) + len(sets[b]) - common)}
        df = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, elements binary")
        split = spark.createDataFrame([(1, i, i) for i in range(len(sets))], "gid long, node long, comp long")
        pairs = {(r.a, r.b) for r in jaccard._possible(split, df, threshold).collect()}
        assert len(similar) >= 10 and similar <= pairs and len(pairs) <= len(similar) + 100


def made_by_joins(plan):
    """Rows that the joins of an executed plan with a condition made."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return made_by_joins(plan.finalPhysicalPlan())
    if name.startswith("ShuffleQueryStage"):
        return made_by_joins(plan.plan())
    own = plan.metrics().get("numOutputRows").get().value() if "Join" in name and "a_comp" in plan.simpleString(10_000) else 0
    return own + sum(made_by_joins(plan.children().apply(i)) for i in range(plan.children().size()))


def test_a_pair_that_shares_many_groups_is_made_once(spark):
    rnd = np.random.default_rng(5)
    threshold, base = Fraction(85, 100), rnd.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.append(rnd.permutation(base)[:195], rnd.integers(0, 2**63, 3).astype(np.uint64)) for _ in range(30)]
    df = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, elements binary")
    members = [(g, i, i) for g in range(12) for i in range(30) if g == 3 or rnd.random() < 0.8]
    members = [m for m in members if m[0] != 3 or m[1] < 15]
    together = {(a, b) for g, a, _ in members for h, b, _ in members if g == h and a < b}
    pairs = jaccard._possible(spark.createDataFrame(members, "gid long, node long, comp long"), df, threshold)
    rows = [(r.a, r.b) for r in pairs.collect()]
    assert set(rows) == together and len(rows) == len(together)
    assert made_by_joins(pairs._jdf.queryExecution().executedPlan()) == len(together)


def test_sets_that_only_share_a_passage_do_not_move(spark, monkeypatch):
    rnd = random.Random(12)
    passage = [f"p{k}" for k in range(120)]
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts = [" ".join(words(120) + passage + words(80)) for _ in range(150)]
    texts += [t.replace("p7 ", "q7 ") for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    asked, sets = [], jaccard._sets
    monkeypatch.setattr(jaccard, "_sets", lambda d, w, facts, wanted: asked.append(wanted.count()) or sets(d, w, facts, wanted))
    got = {r.doc_id: r.component_id for r in jaccard.link_components(docs, 5, Fraction(4, 5)).collect()}
    assert got == {i: i if i < 150 else i - 150 for i in range(160)}
    assert 20 <= asked[0] <= 30


@pytest.mark.parametrize("many", [3, 3000])
def test_screened_rows_hold_every_wanted_one(spark, many):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    out = screened(rows, rows.filter(F.col("doc_id") < many), "doc_id").collect()
    may = {r.doc_id for r in out if r.may}
    assert len(out) == 20_000 and may >= set(range(many)) and len(may) < many + 50
