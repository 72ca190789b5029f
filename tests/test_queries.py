"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as spark_entry
from demandloom.plans import catalog
from tools.check_queries import compare, connect

@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    result = compare(spark, duck, name, sf)
    assert result.startswith(("ok", "rows-only")), result


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
