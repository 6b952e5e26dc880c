"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
#: No question of the smallest corpus meets a definition.
MAY_BE_EMPTY = {"q03_where_defined_refs"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(autouse=True)
def fresh(spark):
    yield
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    query = entry.queries()[name]
    if name not in SQL:
        assert query(spark, SF).count() > 0
        return
    problem = compare(spark, con, SF, name, query, SQL[name])
    assert problem is None or problem == "no rows" and name in MAY_BE_EMPTY


def test_every_statement_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.text.startswith("Project with") for r in rows)
