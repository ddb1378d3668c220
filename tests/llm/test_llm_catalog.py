import pytest
from cases import SF
from oracle import compare, connect

from spanweave.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL_TEXT))
def test_queries_agree_with_their_sql(spark, name):
    assert compare(spark, connect(SF), name, catalog.QUERIES[name], catalog.SQL_TEXT[name], SF) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
