"""The registered queries of the operators for training data, each over its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filetrail.llm import (
    filter_audit, jaccard, lines, main_text, near_vectors, neighbours, packing, pieces, quality, records, sharding, substrings, turns)
from filetrail.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_records(spark, sf_dir):
    index = records.with_starts(records.write_records(table(spark, sf_dir, "documents"), end_id=0))
    return records.read_records(index)


@query
def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), length=2048, end_id=1)


@query
def op2_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


@query
def op3_ngram_jaccard(spark, sf_dir):
    return jaccard.link_components(table(spark, sf_dir, "documents"), words=4, threshold=Fraction(85, 100))


@query
def op7_substring_dedup(spark, sf_dir):
    return substrings.removal_report(table(spark, sf_dir, "documents"), length=200)


@query
def op5_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents"), run=2, report=True)


ORACLES["op5_line_dedup"] = lines.ORACLE_SQL


@query
def op8_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op9_near_vectors(spark, sf_dir):
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


@query
def op4_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = filter_audit.ORACLE_SQL


@query
def op12_main_text(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages"))


@query
def op13_turn_repair(spark, sf_dir):
    return turns.repair(turns.damage(table(spark, sf_dir, "conversations")))


ORACLES["op13_turn_repair"] = turns.ORACLE_SQL
