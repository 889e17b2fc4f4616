"""A corpus pipeline of operators for training data: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filetrail.llm import jaccard, lines, packing, quality, substrings
from filetrail.llm.common import stage, table
from filetrail.session import small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(apply: Stage) -> Stage:
    """The stage with its jobs in small batches, also when it is called alone; what it leaves to the caller's write follows the session."""
    @wraps(apply)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            return apply(spark, docs, sf_dir)

    return run_stage


@bounded
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, takes for good; null and empty texts are scored as empty ones."""
    known = docs.select("doc_id", "text").filter(~quality.held_out(F.col("doc_id")))
    model = quality.train(known, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score(docs, model, "pipeline_quality_score")
    return scored.filter("pipeline_quality_score >= 0.3").select(docs.columns)


@bounded
def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of runs of two lines or more, and of single lines of 50 words or more."""
    return lines.dedup_lines(docs, run=2, words=50)


@bounded
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked by similarities of 0.8 or more."""
    return jaccard.keep_one(docs, words=5, threshold=Fraction(4, 5))


@bounded
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of strings of 200 that start elsewhere too."""
    return substrings.remove_repeats(docs, length=200)


@bounded
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.pack(docs, length=2048, end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("line dedup", lines_stage),
    ("n-gram jaccard join", jaccard_stage),
    ("suffix-array dedup", substring_stage),
    ("packing", packing_stage),
]

# Trained models, token ids and byte-level matches have no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`, each over the staged rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for i, (name, apply) in enumerate(STAGES):
            docs = apply(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = stage(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
