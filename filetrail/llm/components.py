"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filetrail.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of `links` (a, b).

    Each round sends every node to its smallest neighbour and goes on with the links between those, which at least halves the
    nodes that still have links; the rounds are then read back to front. Both ends of all work are aggregates and joins.
    """
    maps: list[DataFrame] = []
    edges = links.filter("a != b").select("a", "b")
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("label")), "component-map")
        if to.isEmpty():
            break
        maps.append(to)
        left, right = to.select(F.col("node").alias("a"), F.col("label").alias("la")), to.select(
            F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = stage(edges.join(left, "a").join(right, "b").filter("la != lb").select(
            F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "component-links")
    if not maps:
        return links.sparkSession.createDataFrame([], "node long, label long")
    labels = maps[-1]
    for to in reversed(maps[:-1]):
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("final"))
        labels = to.join(later, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    return labels
