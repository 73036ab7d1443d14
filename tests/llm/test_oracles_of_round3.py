"""The registered queries of operators 11 to 13 against their SQL."""

import pytest

from kassa.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle_harness import compare, duck


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_sharding", "op13_prefix_trie"])
def test_query_equals_sql(spark, sf_small, name):
    result = compare(spark, sf_small, name, QUERIES[name], ORACLE_SQL[name], duck(sf_small))
    assert result["status"] == "ok" and result["rows"], result
