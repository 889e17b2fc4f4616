"""Line dedup against a plain pass over all runs."""

import hashlib
import random

import pytest
from filetrail.llm import lines
from pyspark.sql import functions as F


def brute(rows, run):
    order = sorted(set(rows), key=lambda r: r[0])
    seen, out = {}, {}
    full = {r: [(i, x) for i, x in enumerate((r[1] or "").split("\n")) if x.strip(" ")] for r in order}
    for r in order:
        for k in range(len(full[r]) - run + 1):
            seen.setdefault(tuple(x for _, x in full[r][k:k + run]), (r, k))
    for r in order:
        gone = set()
        for k in range(len(full[r]) - run + 1):
            if seen[tuple(x for _, x in full[r][k:k + run])] != (r, k):
                gone.update(range(k, k + run))
        kept, nth = [], -1
        for x in (r[1] or "").split("\n"):
            nth += x.strip(" ") != ""
            if nth not in gone:
                kept.append(x)
        stretches = sum(k - 1 not in gone for k in gone)
        out[r] = (r[0], len(full[r]), len(gone), stretches, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return sorted(out[r] for r in rows)


@pytest.mark.parametrize("run", [1, 2, 5])
def test_equals_brute_force(spark, run):
    rnd = random.Random(run)
    blocks = [[f"line {rnd.randrange(40)}" for _ in range(rnd.randint(1, 9))] for _ in range(12)]
    rows = []
    for i in range(80):
        text = "\n".join(x for _ in range(rnd.randint(0, 4)) for x in rnd.choice([*blocks, ["", "  "], [f"own {i} {rnd.random()}"]]))
        rows.append((i * 2, text))
    rows += [(500, rows[7][1]), (501, rows[7][1]), (502, None), (503, "\n \n"), (504, "a\n" * 300), (505, "x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"text_key": F.lit(1), "copy": F.lit("c")}).repartition(4)
    got = lines.dedup_lines(docs, run, report=True).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_deleted, r.n_stretches, r.kept_sha256) for r in got) == brute(rows, run)
    texts = {r.doc_id: r.text for r in lines.dedup_lines(docs, run).collect()}
    assert texts[502] is None and len(texts) == len(rows)
    assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in texts.items()} == {r.doc_id: r.kept_sha256 for r in got}


def test_odd_rows(spark):
    rows = [(1, "a\nb\nc", 5, "k"), (1, "a\nb\nc", 5, "k"), (None, "p\nq", 3, None), (3, "p\nq\na\nb", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, starts string")
    got = sorted(((r.doc_id or 0), r.text, r.n_chars) for r in lines.dedup_lines(docs).collect())
    assert got == [(0, "p\nq", 3), (1, "a\nb\nc", 5), (1, "a\nb\nc", 5), (3, "", 0)]
    assert lines.dedup_lines(docs).columns == docs.columns
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def brute_passages(rows, run, words):
    seen, out = set(), []
    for d, text in sorted(rows):
        found = (text or "").split("\n")
        full = [x for x in found if x.strip(" ")]
        gone = set()
        for k, x in enumerate(full):
            several, alone = tuple(full[k:k + run]), (x, "alone")
            if len(several) == run:
                gone.update(range(k, k + run) if several in seen else ())
                seen.add(several)
            if len(x.split()) >= words:
                gone.update([k] if alone in seen else ())
                seen.add(alone)
        kept, nth = [], -1
        for x in found:
            nth += x.strip(" ") != ""
            if nth not in gone:
                kept.append(x)
        out.append((d, len(full), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("run", [1, 2, 5])
def test_passages_on_a_line_of_their_own_go_too(spark, run):
    rnd = random.Random(run)
    passages = [" ".join(f"p{k}w{rnd.randrange(9)}" for _ in range(n)) for k, n in enumerate([49, 50, 51, 300])]
    passages.append("\t".join("x" * 50))
    rows = []
    for i in range(60):
        own = [[f"own {i} {k}", rnd.choice(passages), rnd.choice(["", f"other {rnd.randrange(5)}"])] for k in range(rnd.randint(0, 3))]
        rows.append((i, "\n".join(x for part in own for x in part)))
    rows += [(100 + i, p) for i, p in enumerate([*passages, *passages])] + [(200, "short"), (201, "short"), (202, rows[4][1]), (None, passages[2])]
    expected = brute_passages([(-1 if d is None else d, t) for d, t in rows], run, 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lines.dedup_lines(docs, run, report=True, words=50).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_deleted, r.n_stretches, r.kept_sha256) for r in got) == expected


def test_pipeline_stage_deletes_lone_passages(spark):
    import corpus_pipeline
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd"), (3, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines_stage(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "c\nd", 3: ""}


def test_other_white_space_is_no_blank_line(spark):
    rnd, rows = random.Random(2), []
    for k, end in enumerate(["\r", "\x85", "\u2028", "\u2029", "\t", "\xa0", "\x0b"]):
        for i in range(12):
            found = [rnd.choice(["", " ", "A", "B", "C", f"own {k} {i}"]) + rnd.choice(["", " ", end, " " + end]) for _ in range(rnd.randint(0, 12))]
            rows.append((len(rows), "\n".join(found)))
        rows.append((len(rows), f"A{end}\n{end}\nB{end}\nC{end}\n"))
        rows.append((len(rows), f"X{end}\n{end}\n  {end}\nB{end}\nC{end}\n"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lines.dedup_lines(docs, 2, report=True).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_deleted, r.n_stretches, r.kept_sha256) for r in got) == brute(rows, 2)


@pytest.mark.parametrize("run", [1, 2, 3])
def test_maximal_runs(spark, run):
    rnd = random.Random(run)
    base = [[f"line {rnd.randrange(30)}" for _ in range(rnd.randint(1, 40))] for _ in range(8)]
    rows = [(i, "\n".join(x for _ in range(rnd.randint(0, 3)) for x in rnd.choice([*base, [f"own {i}"]]))) for i in range(60)]
    rows += [(200, "a\n" * 37), (201, "\n".join(base[0] * 5)), (202, None), (203, rows[3][1])]
    full = {d: [x for x in (t or "").split("\n") if x.strip(" ")] for d, t in rows}
    place = lambda d: min(o for o, t in rows if t == dict(rows)[d])
    got = lines.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), run).collect()
    covered, matches = set(), set()
    for d, p, n, e, q in got:
        mine, first = full[d][p:], full[e][q:]
        common = next((k for k, (x, y) in enumerate(zip(mine, first)) if x != y), min(len(mine), len(first)))
        assert (e, q) < (d, p) and n == common >= run and place(d) == d and place(e) == e
        covered.update((d, k) for k in range(p, p + n))
        matches.add((d, p, e, q))
    assert not any((d, p - 1, e, q - 1) in matches for d, p, e, q in matches) and len(matches) == len(got)
    seen, expected = {}, set()
    for d in sorted({place(d) for d in full}):
        for p in range(len(full[d]) - run + 1):
            if seen.setdefault(tuple(full[d][p:p + run]), (d, p)) != (d, p):
                expected.update((d, k) for k in range(p, p + run))
    assert covered == expected


def test_a_long_copy_is_one_run(spark):
    rows = [(1, "\n".join(f"l{i}" for i in range(1000))), (2, "\n".join(["x", *[f"l{i}" for i in range(3, 990)], "y"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in lines.repeated_runs(docs).collect()] == [(2, 1, 987, 1, 3)]
    assert lines.repeated_runs(docs.limit(1)).count() == 0
