"""The corpus pipeline stage by stage on the small table: decisions take effect and agree with plain reasoning."""

import corpus_pipeline
import numpy as np
import pytest
from filetrail.llm import packing
from filetrail.llm.common import stage, table
from filetrail.llm.tokens import Encoder, vocabulary_path

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF_DIR, "documents"), []
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF_DIR), "test-pipeline")
        out.append((name, docs))
    return out


def test_names_and_columns(spark, stages):
    assert [n for n, _ in stages] == ["quality classifier", "line dedup", "n-gram jaccard join", "suffix-array dedup", "packing"]
    columns = table(spark, SF_DIR, "documents").columns
    assert all(df.columns == columns for _, df in stages[:-1])


def test_stages_keep_and_drop_what_they_should(spark, stages):
    rows = [{r.doc_id: r for r in df.collect()} for _, df in stages[:-1]]
    labels = {r.doc_id: r.quality for r in table(spark, SF_DIR, "labels").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in rows[0] for d in good) >= 0.95 * len(good)
    assert set(rows[1]) == set(rows[0]) and set(rows[2]) <= set(rows[1]) and set(rows[3]) == set(rows[2])
    lines = [tuple(x.text.split("\n")[i:i + 2]) for x in rows[1].values() for i in range(x.text.count("\n"))]
    assert len(lines) - len(set(lines)) <= 0.02 * len(lines)  # what deletion itself brings together may repeat
    texts = [r.text.encode() for r in rows[3].values()]
    assert all(r.n_chars == len(r.text) for r in rows[3].values())
    windows = [t[i:i + 210] for t in texts for i in range(0, max(0, len(t) - 210), 7)]
    assert len(windows) - len(set(windows)) <= 0.01 * max(1, len(windows))


def test_packed_ids_are_those_of_the_kept_texts(stages):
    encoder = Encoder.of(vocabulary_path())
    kept = {r.doc_id: r.text for r in stages[-2][1].collect()}
    pieces = stages[-1][1].collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == {
        d: len(np.frombuffer(encoder.encode([t])[0], encoder.dtype)) + 1 for d, t in kept.items()}
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
    assert "length" in packing.PIECES


def test_empty_documents(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_a_stage_called_alone_works_in_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    monkeypatch.setattr(corpus_pipeline.jaccard, "keep_one", lambda docs, **_: seen.append(int(spark.conf.get(name))) or docs)
    before = spark.conf.get(name)
    dict(corpus_pipeline.STAGES)["n-gram jaccard join"](spark, spark.range(1), "")
    assert seen == [8 << 20] and spark.conf.get(name) == before
