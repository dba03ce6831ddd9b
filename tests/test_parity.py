"""Every registered query against its SQL, on the smallest tables."""

import parity
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Queries of the subpackage with its own tests are left to them.
QUERIES = {name: build for name, build in entry.queries().items() if name not in entry.LLM_QUERIES}
CHECKS = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return parity.connect(SF)


def test_every_check_has_its_query():
    assert set(CHECKS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    columns, rows = parity.spark_rows(QUERIES[name](spark, SF))
    assert len(columns) == len(set(columns))
    if name in CHECKS:
        assert (columns, rows) == parity.duck_rows(duck, CHECKS[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
