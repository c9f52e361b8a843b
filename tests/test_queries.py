from __future__ import annotations

import pytest

from docspark import catalog
from tests.oracle import check

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    check(spark, data, catalog.queries()[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())
