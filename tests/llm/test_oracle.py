import pytest

from mixtally.llm import queries
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.ORACLE_SQL[name])
