"""Depths on chains, self-loops and longer cycles; results table; graph export."""

from filetrail.operators import lineage
from filetrail.sources import results


def graph(spark, order, parents):
    nodes = spark.createDataFrame([("s", f, n) for n, f in enumerate(order)], "session_id string, file_id string, arrival long")
    edges = spark.createDataFrame(
        [("s", p, c, "derived") for c, p in parents.items()], "session_id string, source string, target string, label string")
    return nodes, edges


def depths(spark, order, parents):
    nodes, edges = graph(spark, order, parents)
    return {r.file_id: r.depth for r in lineage.lineage_depth(nodes, edges).collect()}


def test_chain_below_a_root(spark):
    order = [f"n{i}" for i in range(20)]
    parents = {f"n{i}": f"n{i - 1}" for i in range(1, 20)}
    assert depths(spark, order, parents) == {f"n{i}": i for i in range(20)}


def test_cycles_beside_a_root_start_at_their_first_upload(spark):
    # r is a root; b -> a -> b is a cycle with c below a; s is its own parent with t below it.
    parents = {"a": "b", "b": "a", "c": "a", "s": "s", "t": "s", "d": "r"}
    order = ["r", "d", "c", "a", "b", "s", "t"]
    # c comes before its ancestors, so it starts a tree of its own; a is the first upload of the cycle.
    assert depths(spark, order, parents) == {"r": 0, "d": 1, "c": 0, "a": 0, "b": 1, "s": 0, "t": 1}


def test_no_root_means_no_depth(spark):
    assert depths(spark, ["a", "b", "c"], {"a": "a", "b": "a", "c": "b"}) == {"a": 0, "b": 0, "c": 0}
    nodes, edges = graph(spark, ["a", "b"], {"a": "a", "b": "a"})
    assert {r.file_id for r in lineage.lineage_roots(nodes, edges).collect()} == {"a", "b"}


def test_results_table_replaces_and_reads_points(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "session_id string, file_id string, arrival long, filename string"
    first = spark.createDataFrame([("s", "x", 1, "one"), ("s", "y", 2, "two"), ("u", "z", 3, "three")], schema)
    results.write_results(first, path)
    results.write_results(spark.createDataFrame([("s", "x", 4, "again")], schema), path)
    results.write_results(spark.createDataFrame([("s", "x", 4, "again")], schema), path)
    table = results.read_results(spark, path, first.schema)
    assert sorted((r.file_id, r.arrival, r.filename) for r in table.collect()) == [
        ("x", 4, "again"), ("y", 2, "two"), ("z", 3, "three")]
    assert [r.file_id for r in results.prior_files(table, "s").collect()] == ["y", "x"]
    assert results.lookup_result(table, "u", "z").count() == 1
    assert results.lookup_result(table, "u", "x").count() == 0


def test_graph_export(spark, tmp_path):
    nodes, edges = graph(spark, ["a", "b"], {"b": "a"})
    results.write_graph(nodes, edges, str(tmp_path / "g"), "json")
    assert spark.read.json(str(tmp_path / "g" / "nodes")).count() == 2
    assert spark.read.json(str(tmp_path / "g" / "edges")).first().target == "b"
