"""Limits on what a Python worker is handed at a time."""

import pyarrow as pa
import pytest
from filetrail.session import small_batches


def test_small_batches_are_put_back(spark):
    name, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    rows = spark.range(200, numPartitions=1).selectExpr("repeat('x', 100000) as text")

    def lengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    with small_batches(spark, 1 << 20):
        sizes = [r.n for r in rows.mapInArrow(lengths, "n long").collect()]
        assert max(sizes) < 2 << 20 and sum(sizes) >= 200 * 100000
        with pytest.raises(ZeroDivisionError), small_batches(spark, 5):
            1 / 0
        assert spark.conf.get(name) == str(1 << 20)
    assert spark.conf.get(name) == before
