"""Every registered query against its DuckDB oracle SQL on the smallest tables
(the driver runs the same comparison at sf0.01)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from kassa.plans import catalog, oracle
from tests.oracle_harness import compare, duck

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


def test_every_query_is_registered_with_sql_or_declared_rows_only():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_small, con, name):
    result = compare(spark, sf_small, name, catalog.queries()[name], oracle.oracle_sql()[name],
                     con)
    assert result["status"] == "ok", result


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_transactions"] == 4184
