import pytest
from oracle import compare

from tessera.llm.oracles import oracle_sql
from tessera.llm.queries import queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, name, queries()[name], oracle_sql()[name], "/root/testdata/sf0.001") == (200 if name != "op2_suffix_dedup" else 36)
