import pytest

from tests.compare import connect, same
from vellum.llm import queries, sharding

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert same(queries.queries()[name](spark, sf_dir), con, SQL[name]) > 0


@pytest.mark.parametrize("limit", [3_000, 40_000, 400_000])
def test_shards_equal_sql_for_small_limits(spark, sf_dir, con, limit):
    out = sharding.report(spark.read.parquet(f"{sf_dir}/documents.parquet"), limit)
    assert same(out, con, sharding.oracle(limit)) > 0
