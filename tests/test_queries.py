"""Every registered query against its SQL over the same tables."""

import pytest
import runall

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return runall.duck(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_its_sql(spark, duck, name):
    status, _ = runall.check(spark, duck, SF_DIR, name)
    assert status.startswith("ok" if name in ORACLES else "rows only"), status
    assert not status.endswith(" 0"), "a query without rows proves nothing"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
