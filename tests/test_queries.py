"""Every query of the engine runs; those with SQL give the rows of DuckDB."""

import pytest

from tests.oracle import connect, rows_of, sql_rows
from weftline.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    assert rows_of(catalogue.QUERIES[name](spark, sf_dir)) == sql_rows(duck, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    columns, rows = rows_of(catalogue.QUERIES[name](spark, sf_dir))
    assert rows and len(set(columns)) == len(columns)
