import pytest
from oracle import compare

from tessera.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, QUERIES[name], SQL[name], "/root/testdata/sf0.001") >= 0
