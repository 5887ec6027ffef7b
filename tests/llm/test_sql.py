import pytest

from groundframe.llm.queries import QUERIES, SQL

from .oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], SQL[name])
