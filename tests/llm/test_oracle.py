import pytest
from oracle_check import compare, connect

from tidewire.llm.queries import REGISTRY, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, name):
    assert compare(REGISTRY[name](spark, folder), connect(folder), SQL[name]) == ""
