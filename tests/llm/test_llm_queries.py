"""Every query of the subpackage runs, and gives the rows of its SQL where there is any."""

import pytest
from oracle import compare

from facetrank.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, data, name):
    assert not compare(spark, name, QUERIES[name], ORACLE[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
