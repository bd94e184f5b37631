import pytest
from oracle import assert_same

from wayweave.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_statement(spark, name):
    assert_same(spark, SF, queries.QUERIES[name], oracles.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES)))
def test_query_runs_over_the_whole_table(spark, name):
    out = queries.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert out.count() == n if name.startswith(("op1_", "op2_", "op3_", "op5_")) else out.count() > 0
