import pytest

from mixtally import catalogue, catalogue_files  # noqa: F401
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_same(spark, SF, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_runs(spark, name):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    if name == "em_squarem":
        assert sum(r.f for r in rows) == pytest.approx(1)
    if name == "local_alignment":
        assert all(r.score > 0 and r.loglik <= 0 for r in rows)
    assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["read_id", "ref_id"] and set(entry.oracle_sql()) <= set(entry.queries())
