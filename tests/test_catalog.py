"""Every core query with SQL gives what the SQL gives, at the smallest scale."""

from pathlib import Path

import pytest

from pagemill import catalog
from tests.compare import compare, oracle

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(DATA).exists():
        pytest.skip("no test data")
    return oracle(DATA)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, con, name):
    assert not compare(spark, con, DATA, name, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, con, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark, con):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
