"""The filter audit against a count over documents, for every order of the filters."""

import re
from collections import Counter
from itertools import permutations

import pytest
from filetrail.llm import filter_audit
from filetrail.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def failing(text, copy):
    words = WORD.findall(text)
    found = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    found += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return found + "E" * copy


def brute(docs, labels):
    smallest, good, toxic = {}, set(), set()
    for doc, text, _ in docs:
        if doc is not None:
            smallest[text or ""] = min(doc, smallest.get(text or "", doc))
    for doc, quality, bad in labels:
        good |= {doc} if quality == 1 else set()
        toxic |= {doc} if bad == 1 else set()
    facts = [(part or "", failing(text or "", doc is not None and doc > smallest[text or ""]), doc is not None and doc in good,
              doc is not None and doc in toxic) for doc, text, part in docs]
    rows, total = [], Counter()
    for part in {f[0] for f in facts}:
        for order in map("".join, permutations("ABCDE")):
            alive = [f for f in facts if f[0] == part]
            everyone = list(alive)
            for step, letter in enumerate(order, 1):
                out = [f for f in alive if letter in f[1]]
                hit = sum(letter in f[1] for f in everyone)
                alive = [f for f in alive if letter not in f[1]]
                total[part, letter] += len(out)
                rows.append((part, order, step, len(alive), len(out), hit - len(out), sum(f[1] == letter for f in everyone),
                             sum(f[2] for f in out), sum(f[3] for f in out)))
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in rows)


ODD = [
    (1, "Plain words here.", "a"), (2, "Plain words here.", "b"), (2, "Plain words here.", "b"), (None, "Plain words here.", "b"), (3, None, None),
    (4, "", ""), (5, "", "a"), (None, None, "a"), (6, "SHOUT " * 300, "a"), (7, "SHOUT " * 300, None), (8, "w" * 90_000 + " $", "b"),
    (9, " \t ".join(f"w{i}" for i in range(400)), "b"), (10, "É é x\x85y\x0bz", "a"), (-3, "SHOUT " * 300, "c"), (11, "a b " * 99 + "a\n", "a"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (5, None, 1), (7, 1, None), (77, 1, 1)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    clashing = docs.selectExpr("*", "'x' as part", "1 as mask", "2 as n", "doc_id as digest")
    got = sorted(map(tuple, filter_audit.audit(clashing, labels.selectExpr("*", "1 as good")).collect()))
    assert got == brute(ODD, LABELS)


def test_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, QUERIES["op11_filter_audit"](spark, SF_DIR).collect())) == brute(docs, labels)


def test_hot_text_and_other_filters(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same', concat('t ', id)) as text", "'s' as host")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(docs, none, {"L": lambda t: t.endswith("1")}, part="host").collect()
    assert sorted(tuple(r)[1:7] for r in rows) == [
        ("EL", 1, 2001, 999, 0, 999), ("EL", 2, 1801, 200, 0, 200), ("LE", 1, 2800, 200, 0, 200), ("LE", 2, 1801, 999, 0, 999)]
    assert {(r.filter_order[r.step - 1], r.shapley) for r in rows} == {("E", 1998), ("L", 400)}
    with pytest.raises(ValueError):
        filter_audit.walk(spark.range(1).selectExpr("0 as mask"), "A'")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert filter_audit.audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).count() == 0
