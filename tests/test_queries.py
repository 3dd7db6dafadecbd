"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from evenkeel.plans import registry
from tests.oracle import duck, rows_of_frame, rows_of_sql


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    columns, rows = rows_of_frame(registry.QUERIES[name](spark, sf))
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    assert (columns, rows) == rows_of_sql(con, registry.ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
    assert len(registry.QUERIES) == 104


def test_own_views_stay(spark, sf):
    spark.range(3).createOrReplaceTempView("orders")
    registry.QUERIES["mart_customers"](spark, sf).count()
    assert spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")
