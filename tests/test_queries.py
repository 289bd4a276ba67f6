"""Every query of the library against its SQL in another engine, and what the rest must return."""

import pytest

from evenkeel.jobs import registry
from tests.compare import connection, same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, data, name):
    same(registry.QUERIES[name](spark, data), connection(data), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 12
