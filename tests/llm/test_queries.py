"""Every query of the subpackage against its SQL, on the smallest data."""

import os

import pytest

from strandflow.llm import queries

from ..compare import DATA, check, duck

there = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data in place")


@there
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, name):
    check(spark, duck(), name, queries.QUERIES[name], queries.ORACLE[name])


@there
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
