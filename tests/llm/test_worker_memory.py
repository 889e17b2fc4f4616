"""What a step leaves in Python workers does not stay there beside the next step's."""

import sys

import pyarrow as pa
import pytest
from filetrail.llm import jaccard, packing
from filetrail.llm.common import lean, worker_store


def test_a_step_drops_the_stores_of_others():
    worker_store("encoders")["a"], worker_store("powers")["b"] = 1, 2
    seen = []

    def run(batches):
        for batch in batches:
            seen.append(sorted(n for n in vars(sys.modules["filetrail_worker_store"]) if not n.startswith("__")))
            yield batch

    assert list(lean(run, "powers")(iter([1, 2]))) == [1, 2]
    assert seen == [["powers"]] * 2 and worker_store("powers") == {"b": 2} and worker_store("encoders") == {}

    def fail(batches):
        worker_store("powers")["c"] = 3
        raise ZeroDivisionError
        yield

    with pytest.raises(ZeroDivisionError):
        list(lean(fail)(iter([])))
    assert worker_store("powers") == {}


def test_the_encoder_is_gone_from_workers_after_packing(spark):
    def held(batches):
        for _ in batches:
            pass
        store = sys.modules.get("filetrail_worker_store")
        yield pa.RecordBatch.from_arrays([pa.array([len(getattr(store, "encoders", {}))])], names=["n"])

    docs = spark.createDataFrame([(i, f"some words of text {i} and more of them") for i in range(64)], "doc_id long, text string").repartition(8)
    assert packing.pack(docs, length=2048, end_id=1).count() >= 64
    jaccard.keep_one(docs, words=5, threshold=0.8).count()
    # Workers are lent last in, first out, so as many tasks as wrote ids look.
    assert sum(r.n for r in spark.range(8, numPartitions=8).mapInArrow(held, "n long").collect()) == 0
