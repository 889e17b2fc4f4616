"""Compression classifier: how much better a text compresses with a dictionary of good texts than with one of bad texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filetrail.llm.common import keep_stores, worker_store

# Bounds of what the fit sees; everything scored is scored whole.
ROWS_PER_CLASS = 2_000  # labelled texts of each class, lowest hashes of the text first
LONGEST = 32 << 10  # bytes; longer labelled texts are not learned from
DICTIONARY = 64 << 10
PIECE = 1 << 10
LEVEL = 3
FRAME = 6  # bytes of framing in each compressed piece


@dataclass
class Model:
    """Two dictionaries, and a logistic calibration of what they show."""

    bad: bytes
    good: bytes
    low: np.ndarray  # range of each feature in the calibration; others count as its ends
    high: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        terms = _terms(np.clip(features, self.low, self.high), self.centre, self.spread)
        return 1 / (1 + np.exp(-terms @ self.weights))


def held_out(doc_id: Column) -> Column:
    """One row in five, by the crc32 of doc_id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def pieces(data: bytes) -> list[bytes]:
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


def _compressor(dictionary: bytes):
    import zstandard

    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def features_of(data: list[bytes], bad, good) -> np.ndarray:
    """Per text: the normalised difference of its compressed sizes, both sizes against its length, and its length's logarithm."""
    out = np.zeros((len(data), 4))
    for i, text in enumerate(data):
        cut = pieces(text)
        a = sum(len(good.compress(p)) for p in cut) - FRAME * len(cut)
        b = sum(len(bad.compress(p)) for p in cut) - FRAME * len(cut)
        out[i] = (b - a) / (a + b + 1), a / (len(text) + 1), b / (len(text) + 1), np.log1p(len(text))
    return out


def _terms(features: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = (features - centre) / spread
    pairs = [z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i, z.shape[1])]
    return np.column_stack([np.ones(len(z)), z, *pairs])


def _logistic(features: np.ndarray, marks: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Range and scale of the features and the weights, by Newton steps on the regularised likelihood."""
    low, high = features.min(0), features.max(0)
    centre, spread = features.mean(0), features.std(0) + 1e-9
    terms = _terms(features, centre, spread)
    w = np.zeros(terms.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-terms @ w))
        gradient = terms.T @ ((p - marks) * weight) / weight.sum() + 1e-3 * w
        curve = (terms * (p * (1 - p) * weight)[:, None]).T @ terms / weight.sum() + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(curve, gradient)
    return low, high, centre, spread, w


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the labelled documents: two thirds of a bounded sample make the dictionaries, one third calibrates.

    The sample holds at most `ROWS_PER_CLASS` texts of up to `LONGEST` bytes of each class, chosen by a hash of doc_id before any
    text moves; the calibration weighs them by the classes' true counts. Null texts or marks are not learned from. None when a
    class has too few texts.
    """
    import zstandard

    known = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("mark"))
    usable = known.join(docs.filter(F.octet_length("text").between(1, LONGEST)).select("doc_id"), "doc_id")
    counts = {r["mark"]: r["n"] for r in usable.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    sample: dict[int, list[bytes]] = {}
    for mark in (0, 1):
        chosen = usable.filter(F.col("mark") == mark).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS_PER_CLASS)
        texts = docs.filter(F.octet_length("text").between(1, LONGEST)).join(F.broadcast(chosen.distinct()), "doc_id")
        sample[mark] = sorted(r["text"].encode() for r in texts.select("text").limit(2 * ROWS_PER_CLASS).collect())
    dictionaries, rest, marks, weight = [], [], [], []
    for mark in (0, 1):
        learn = [t for i, t in enumerate(sample[mark]) if i % 3]
        check = sample[mark][::3]
        try:
            trained = zstandard.train_dictionary(DICTIONARY, [p for t in learn for p in pieces(t)], level=LEVEL)
        except (zstandard.ZstdError, ValueError):  # too little text of one class
            return None
        dictionaries.append(trained.as_bytes())
        rest += check
        marks += [mark] * len(check)
        weight += [counts[mark] / len(check)] * len(check)
    shown = features_of(rest, *map(_compressor, dictionaries))
    return Model(*dictionaries, *_logistic(shown, np.array(marks, float), np.array(weight)))


def score(docs: DataFrame, model: Model | None, column: str = "quality_score") -> DataFrame:
    """Add the calibrated score (0 to 1, higher: good likelier) of each whole text; all columns stay.

    Null and empty texts get the score of an empty text; without a model (too few labels) every score is 0.5. A column of the
    score's name is replaced.
    """
    docs = docs.drop(column)
    if model is None:
        return docs.withColumn(column, F.lit(0.5))
    key = hash((model.bad, model.good))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keep_stores("compressors")
        store = worker_store("compressors")
        if key not in store:
            store.clear()
            store[key] = _compressor(model.bad), _compressor(model.good)
        for texts in batches:
            data = [t.encode() if t else b"" for t in texts]
            yield pd.Series(model.score(features_of(data, *store[key])) if data else [], dtype="float64")

    return docs.withColumn(column, scored("text"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn from the labelled rows that are not held out, score all: doc_id, held_out, score, predicted.

    Labels join by doc_id; several labels of one doc_id count once each, null ones not at all. Only the text enters a score.
    """
    known = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    scored = score(rows, train(known, labels.select("doc_id", "quality")), "score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
