import os

import pytest
from corvane.plans import registry
from parity import connect, same

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    same(spark, con, D, registry.queries()[name], registry.oracle_sql()[name])


#: the smallest tables have nothing for these to find
EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert (registry.queries()[name](spark, D).count() > 0) != (name in EMPTY)
