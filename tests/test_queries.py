"""Every query with SQL gives the SQL's rows; every other one runs and keeps its contract."""

from __future__ import annotations

import pytest
from conftest import same_rows

from tesserae import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(name, spark, sf_dir, duck):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
