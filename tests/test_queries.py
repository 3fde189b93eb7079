"""Every query of the engine against its SQL; those without SQL must give rows."""

import pytest

from prismframe import catalog
from tests.compare import connection, rows_of


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, sf, con, name):
    a, b = rows_of(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name])
    assert a == b and a


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
