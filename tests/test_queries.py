"""Every query with SQL gives the same rows as its SQL, on the smallest tables."""

import pytest
from oracle import compare

from facetrank.plans import catalogue, checks

ALL = catalogue.QUERIES | checks.QUERIES
SQL = catalogue.ORACLE | checks.ORACLE


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    assert not compare(spark, name, ALL[name], SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, data, name):
    ALL[name](spark, data).collect()


def test_entry_points(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
