"""The derivation graph of every session: nodes, edges, roots and depths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filetrail.operators.rules import badges
from filetrail.session import stage

KEY = ["session_id", "file_id"]
# Orders below any arrival mark roots while depths are computed.
ROOT_ORDER = -(1 << 62)


def session_nodes(results: DataFrame) -> DataFrame:
    """One node per file; `arrival` is the upload order."""
    return results.select(
        *KEY, "arrival", "filename", "verdict", badges(F.col("pipeline_matches")).alias("badges"), "trace_score"
    )


def valid_edges(results: DataFrame, parent: str = "parent_file_id") -> DataFrame:
    """Rows whose parent is a file of the same session. Self-loops stay."""
    known = results.select("session_id", F.col("file_id").alias(parent))
    return results.filter(F.col(parent).isNotNull()).join(known, ["session_id", parent], "left_semi")


def session_edges(results: DataFrame) -> DataFrame:
    """(session_id, source, target, label); the label falls back to `derived`."""
    label = F.coalesce(F.nullif(F.array_join("transformations", ", "), F.lit("")), F.lit("derived"))
    return valid_edges(results).select(
        "session_id", F.col("parent_file_id").alias("source"), F.col("file_id").alias("target"), label.alias("label")
    )


def lineage_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no edge's target; every node of a session in which each one is a target."""
    targets = edges.select("session_id", F.col("target").alias("file_id")).distinct()
    free = nodes.select(*KEY).join(targets, KEY, "left_anti")
    rooted = free.select("session_id").distinct()
    return free.unionByName(nodes.select(*KEY).join(rooted, "session_id", "left_anti"))


def lineage_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Depth of every node in the layout of its session's graph.

    A node has at most one parent. Below a root, depth counts the edges from it. Nodes that no root reaches hang
    on a cycle (a re-upload's self-loop, or a longer one); there, the node uploaded first among a node's ancestors
    and itself is the start, at depth 0. In a session without roots every node has depth 0.

    Pointer doubling: after round k a node knows the best start among 2^k ancestors, so the rounds grow with the
    logarithm of the longest chain. Parents shared by many children make the join's child side skewed only, which
    adaptive execution splits.
    """
    parent = edges.select("session_id", F.col("target").alias("file_id"), F.col("source").alias("up"))
    linked = nodes.select(*KEY, "arrival").join(parent, KEY, "left")
    is_root = F.col("up").isNull()
    return depths(settled(linked.select(
        *KEY, F.coalesce("up", "file_id").alias("up"), F.when(is_root, 0).otherwise(1).cast("bigint").alias("jump"),
        F.when(is_root, ROOT_ORDER).otherwise(F.col("arrival")).alias("start"), F.lit(0).cast("bigint").alias("depth"))))


def settled(state: DataFrame) -> DataFrame:
    """Best start and the depth below it for every row (session_id, file_id, up, jump, start, depth), by pointer doubling.

    A row that points to itself with a jump of 0 ends the walk with its own start and depth.
    """
    state = stage(state, "depth")
    while True:
        ahead = state.select(
            "session_id", F.col("file_id").alias("up"), F.col("up").alias("next_up"),
            F.col("jump").alias("next_jump"), F.col("start").alias("next_start"), F.col("depth").alias("next_depth"),
        )
        better = F.col("next_start") < F.col("start")
        moved = state.join(ahead, ["session_id", "up"]).select(
            *KEY, F.col("next_up").alias("up"), (F.col("jump") + F.col("next_jump")).alias("jump"),
            F.least("start", "next_start").alias("start"),
            F.when(better, F.col("jump") + F.col("next_depth")).otherwise(F.col("depth")).alias("depth"),
            better.alias("changed"),
        )
        state = stage(moved, "depth")
        if state.filter("changed").isEmpty():
            return state


def depths(state: DataFrame) -> DataFrame:
    """(session_id, file_id, depth): in a session without roots every node has depth 0."""
    rooted = state.filter(F.col("start") == ROOT_ORDER).select("session_id").distinct().withColumn("rooted", F.lit(True))
    return state.join(rooted, "session_id", "left").select(
        *KEY, F.when(F.col("rooted"), F.col("depth")).otherwise(0).cast("int").alias("depth")
    )
