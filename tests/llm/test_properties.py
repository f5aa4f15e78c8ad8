"""Properties of the training-data queries that SQL can state, on the smallest tables."""

import oracle
import pytest

from noteforge.llm import queries


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf, con, name):
    assert oracle.compare(queries.QUERIES[name](spark, sf), con, queries.ORACLE[name]) == ""
