"""Every query against its statement; registered names."""

import pytest
from compare import connect, difference

from pulsegrid.llm.checks import CHECKS
from pulsegrid.llm.queries import QUERIES


@pytest.fixture(scope="module")
def duck(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, duck, tiny, name):
    assert difference(QUERIES[name](spark, tiny).toPandas(), duck.sql(CHECKS[name]).df()) is None
