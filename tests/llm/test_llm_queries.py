from __future__ import annotations

import pytest
from conftest import same_rows

from tesserae.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_sql(name, spark, sf_dir, duck):
    same_rows(queries.queries()[name](spark, sf_dir), duck.sql(queries.oracle_sql()[name]))
