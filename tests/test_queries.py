"""Every registered query outside llm against its SQL; those without SQL run and are tested by their own facts."""

import pytest
from support import DATA, same

from quern.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    same(QUERIES[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)
