import pytest

import __spark_entry__ as entry
from eigenspark.plans import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_rows_as_sql(spark, compare, name):
    compare(spark, queries.QUERIES[name], oracles.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.SQL)))
def test_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
