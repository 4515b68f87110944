"""Every registered query against its SQL; those without SQL must at least give rows."""

import pytest

import __spark_entry__ as entry
from tests import oracle

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, oracle.SF).count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
