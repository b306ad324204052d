"""Every core query against its SQL twin on the smallest tables."""

import pytest

from bookspark.plans import catalog
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, con, name):
    df = catalog.queries()[name](spark, data)
    sql = catalog.oracle_sql().get(name)
    if sql:
        same(df, con, sql)
    else:
        assert df.count() > 0


def test_flagship(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
