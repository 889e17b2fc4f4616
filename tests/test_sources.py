"""Scanned files and tables."""

import pytest
from filetrail.plans.queries import oversize_rejects
from filetrail.sources.files import entry_name
from pyspark.sql import functions as F


def test_a_table_of_parts_is_rejected_once_under_its_name(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "one"))
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "orders.parquet")
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = oversize_rejects(spark, str(tmp_path)).filter("filename != 'one'").collect()
    assert sorted(map(tuple, rows)) == [("documents.parquet", "413", None), ("orders.parquet", "413", None)]


@pytest.mark.parametrize("root", ["/data/sf1", "/data/sf1/", "file:/data/sf1", "file:///data/sf1", "other://host/data/sf1"])
def test_entry_names_do_not_depend_on_how_the_root_is_written(spark, root):
    paths = ["file:/data/sf1/orders.parquet", "other://host/data/sf1/documents.parquet/part-0.parquet"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(entry_name(root, F.col("path"))).collect()
    assert [r[0] for r in rows] == ["orders.parquet", "documents.parquet"]
