"""Repeated byte strings against every pair of windows."""

import hashlib
import random

import numpy as np
import pytest
from filetrail.llm import substrings
from pyspark.sql import functions as F

LENGTH = 60


def brute(rows, length):
    seen = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for i, (_, b) in enumerate(data):
        for at in range(len(b) - length + 1):
            seen.setdefault(b[at:at + length], []).append((i, at))
    marks = [bytearray(len(b)) for _, b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, at in places:
                marks[i][at:at + length] = b"\x01" * length
    out = []
    for (d, b), m in zip(data, marks, strict=True):
        runs = sum(m[i] and (i == 0 or not m[i - 1]) for i in range(len(m)))
        out.append((str(d), len(b), sum(m), runs, hashlib.sha256(bytes(c for c, x in zip(b, m, strict=True) if not x)).hexdigest()))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    letters = "abcdefgh é日\n"
    fresh = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passages = [fresh(rnd.choice([30, 55, 60, 61, 70, 150])) for _ in range(8)]
    texts = []
    for _ in range(60):
        texts.append("".join(rnd.choice([fresh(rnd.randint(0, 90)), rnd.choice(passages)]) for _ in range(rnd.randint(0, 6))))
    texts += [texts[3], texts[4], "x" * 500, "x" * 60, "x" * 59, "ab" * 200 + fresh(20), "q" + "ab" * 33, "abc " * 50, fresh(3000)]
    texts += [texts[10] + fresh(5), fresh(7) + texts[11], texts[12][1:], None, "", texts[-1][100:900], texts[-1][500:2000] * 2]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(substrings, "GRAM", 20)
    monkeypatch.setattr(substrings, "STEP_BYTES", 700)
    rows = list(enumerate(corpus(seed)))
    rows += [rows[5], (None, rows[9][1]), (None, "z" * 80), (7, "another text of the same id " * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"at": F.lit(1), "text_key": F.lit("k")}).repartition(3)
    got = substrings.removal_report(docs, LENGTH).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, LENGTH)


def test_removing_keeps_columns_rows_and_whole_characters(spark):
    body = "é" * 150
    rows = [(1, body + "a", 151, "k"), (2, "b" + body, 151, "k"), (3, "alone", 5, None), (4, None, None, None), (5, "same " * 60, 300, "x"),
            (6, "same " * 60, 300, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, text_key string")
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert len(got) == 6 and substrings.remove_repeats(docs).columns == docs.columns
    assert (got[1].text, got[2].text, got[3].text, got[4].text, got[5].text, got[6].text) == ("a", "b", "alone", None, "", "")
    assert got[1].n_chars == 1 and got[3].text_key is None and got[5].n_chars == 0
    assert substrings.removal_report(docs.limit(0)).count() == 0 and substrings.remove_repeats(docs.limit(0)).count() == 0


def test_columns_equal_pairwise_comparison():
    rnd = np.random.default_rng(5)
    for _ in range(30):
        count, columns, length = int(rnd.integers(2, 30)), 24, int(rnd.integers(3, 12))
        strings = rnd.integers(0, 2, (count, columns)).astype(np.uint16)
        strings[rnd.random(strings.shape) < 0.03] = substrings.OUTSIDE
        got = substrings.repeated_columns(strings, length)
        for c in range(columns - length + 1):
            windows = [tuple(w) if substrings.OUTSIDE not in w else None for w in strings[:, c:c + length].tolist()]
            assert got[c].tolist() == [w is not None and windows.count(w) > 1 for w in windows]


@pytest.mark.parametrize("sampled", [False, True])
def test_contexts_of_a_hot_anchor_do_not_meet_in_one_task(spark, monkeypatch, sampled):
    rnd = random.Random(3)
    fresh = lambda n: "".join(rnd.choice("abcdefgh é日\n") for _ in range(n))
    footer, edge = fresh(40), fresh(25)
    rows = [(i, fresh(rnd.randint(0, 80)) + rnd.choice(["", edge]) + footer + rnd.choice(["", edge]) + fresh(rnd.randint(0, 80))) for i in range(300)]
    rows += [(300 + i, t) for i, t in enumerate(corpus(1))] + [rows[5], (None, rows[9][1]), (999, rows[7][1][9:] + rows[7][1])]
    monkeypatch.setattr(substrings, "GRAM", 20)
    monkeypatch.setattr(substrings, "STEP_BYTES", 700)
    monkeypatch.setattr(substrings, "HOT_CONTEXTS", 20, raising=False)
    monkeypatch.setattr(substrings, "SPOT_ROWS", 7, raising=False)
    if sampled:
        monkeypatch.setattr(substrings, "SAMPLE_ONE_IN", 1, raising=False)
        monkeypatch.setattr(substrings, "HOT_IN_SAMPLE", 20, raising=False)
    columns, met = substrings.repeated_columns, substrings._met

    def compared(contexts, length):
        grams = contexts[:, length - 20:length]
        assert np.unique(grams, axis=0, return_counts=True)[1].max(initial=0) <= 20, "one task compares all contexts of an anchor"
        return columns(contexts, length)

    def gathered(entries, *more):
        several = np.unique(entries[0][entries[4] != substrings.TOLD], return_counts=True)[1].max(initial=0)
        assert not sampled or several < 150, "one task gathers all contexts of an anchor"
        return met(entries, *more)

    monkeypatch.setattr(substrings, "repeated_columns", compared)
    monkeypatch.setattr(substrings, "_met", gathered)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.removal_report(docs, LENGTH).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, LENGTH)
