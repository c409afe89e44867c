"""Queries of the text problems on the smallest tables, with SQL where there is some."""

import pytest

from corvane.llm.queries import QUERIES, SQL
from tests.sqlcheck import connect, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    same(spark, connect(small), QUERIES[name], SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_are_distinct(spark, small, name):
    got = QUERIES[name](spark, small)
    if name.endswith("_found"):
        assert got.count() == got.distinct().count()
    else:
        assert got.count() > 0
