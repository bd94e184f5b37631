import pytest
from oracle import assert_same

from wayweave.plans import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_statement(spark, name):
    assert_same(spark, SF, queries.QUERIES[name], oracles.ORACLES[name])


def test_only_nondeterministic_or_driver_queries_have_no_statement():
    assert set(queries.QUERIES) - set(oracles.ORACLES) == {"permutation_search", "simulated_motions"}
