"""The results table: atomic replacement, two writers, failed writers."""

import pytest
from filetrail.sources import results

SCHEMA = "session_id string, file_id string, arrival long, verdict string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stored(spark, path, number=None):
    rows = results.read_results(spark, path, frame(spark, []).schema, number).collect()
    return {(r.session_id, r.file_id): (r.arrival, r.verdict) for r in rows}


def test_insert_or_replace_and_time_travel(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored(spark, path) == {}
    first = results.write_results(frame(spark, [("a", "x", 1, "p"), ("a", "y", 2, "p"), ("b", "x", 3, "p")]), path, 4)
    second = results.write_results(frame(spark, [("a", "x", 5, "q"), ("c", "z", 6, "q"), ("a", "y", 1, "old")]), path, 4)
    want = {("a", "x"): (5, "q"), ("a", "y"): (2, "p"), ("b", "x"): (3, "p"), ("c", "z"): (6, "q")}
    assert (first, second) == (0, 1) and stored(spark, path) == want
    assert stored(spark, path, first) == {("a", "x"): (1, "p"), ("a", "y"): (2, "p"), ("b", "x"): (3, "p")}
    results.write_results(frame(spark, [("a", "x", 5, "q")]), path, 4)
    assert stored(spark, path) == want
    assert results.vacuum_results(spark, path, keep=1) > 0 and stored(spark, path) == want


def test_a_writer_that_fails_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    results.write_results(frame(spark, [("a", "x", 1, "p")]), path, 4)
    before = stored(spark, path)

    def broken(*_):
        raise OSError("lost driver")

    with monkeypatch.context() as patch:
        patch.setattr(results._Manifests, "commit", broken)
        with pytest.raises(OSError):
            results.write_results(frame(spark, [("a", "x", 9, "q"), ("d", "w", 9, "q")]), path, 4)
    assert stored(spark, path) == before
    results.write_results(frame(spark, [("a", "x", 9, "q")]), path, 4)
    assert stored(spark, path) == {("a", "x"): (9, "q")}


@pytest.mark.parametrize("session", ["a", "other"])
def test_two_writers_lose_no_row(spark, tmp_path, monkeypatch, session):
    path = str(tmp_path / "t")
    results.write_results(frame(spark, [("a", "x", 1, "p")]), path, 64)
    commit, rivals = results._Manifests.commit, [frame(spark, [(session, "rival", 7, "r")])]

    def late(self, number, versions):
        if rivals:
            assert results.write_results(rivals.pop(), path, 64) == 1  # another writer comes first
        return commit(self, number, versions)

    monkeypatch.setattr(results._Manifests, "commit", late)
    assert results.write_results(frame(spark, [("a", "y", 2, "q")]), path, 64) == 2
    assert stored(spark, path) == {("a", "x"): (1, "p"), (session, "rival"): (7, "r"), ("a", "y"): (2, "q")}


def test_writers_give_up_when_others_keep_changing_the_bucket(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    commit = results._Manifests.commit

    def always_late(self, number, versions):
        commit(self, number, {b: f"{number}-rival" for b in versions})
        return False

    monkeypatch.setattr(results._Manifests, "commit", always_late)
    with pytest.raises(results.ConflictError):
        monkeypatch.setattr(results, "_versions", lambda spark, path, versions, schema: frame(spark, []).selectExpr("*", "1 as session_bucket"))
        results.write_results(frame(spark, [("a", "y", 2, "q")]), path, 4, attempts=2)
