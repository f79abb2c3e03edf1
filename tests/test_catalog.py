"""Every catalog query against its SQL twin over whole small tables."""

import pytest
from compare import connect, rows_of_both

from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_twin_has_a_query():
    assert not set(TWINS) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, name):
    mine, theirs = rows_of_both(spark, QUERIES[name], TWINS[name], SF, con)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
