import pytest
from check_oracles import compare, connect

import __spark_entry__ as entry_points
from linktm.plans.queries import QUERIES


@pytest.fixture(scope="module")
def database(tables):
    return connect(tables)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, database, tables, name):
    assert compare(spark, database, name, tables) is None


def test_every_query_has_sql():
    assert QUERIES.keys() <= entry_points.queries().keys()
    assert QUERIES.keys() <= entry_points.oracle_sql().keys()


def test_entry(spark):
    assert {r.type for r in entry_points.entry(spark).collect()} == {"TM", "TC", "RMAP", "SPW_RAW"}
