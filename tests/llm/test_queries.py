"""The registered queries: against their SQL, and their contract's columns."""

import pytest

import __spark_entry__ as spark_entry
from demandloom.llm.registry import ORACLES, QUERIES
from tools.check_queries import compare, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, sf, name):
    result = compare(spark, duck, name, sf)
    assert result.startswith("ok"), result


def test_all_are_registered():
    names = set(spark_entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
