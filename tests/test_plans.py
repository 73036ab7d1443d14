"""Plan properties the design relies on at scale, checked on the physical plan."""

from __future__ import annotations

import re

import pytest

from kassa.operators import kpis
from kassa.operators.report import kpi_report
from kassa.plans.stages import enriched
from kassa.sources.tables import TABLES_CONFIG as CFG
from kassa.sources.tables import transactions_from_tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def clean(spark, sf_small):
    return enriched(transactions_from_tables(spark, sf_small), CFG)


def test_fact_table_is_never_broadcast(spark, sf_small):
    plan = _plan(transactions_from_tables(spark, sf_small))
    # every BroadcastExchange subtree must not scan lineitem
    for block in plan.split("BroadcastExchange")[1:]:
        first_scan = re.search(r"FileScan parquet \[([^\]]*)\]", block)
        if first_scan:  # the scan right under this broadcast
            assert "l_orderkey" not in first_scan.group(1)


def test_dedup_limits_before_the_shuffle(clean):
    plan = _plan(clean)
    assert plan.count("WindowGroupLimit") == 2
    exch = plan.index("Exchange hashpartitioning(transaction_id")
    below = plan[exch:]
    assert "row_number(), 1, Partial" in below  # map-side top-1 before the exchange
    assert "row_number(), 1, Final" in plan[:exch]


def test_null_keys_dropped_before_the_shuffle(spark):
    from kassa.config import DEFAULT
    from kassa.operators.clean import clean as clean_op
    from kassa.schema import RAW_SCHEMA
    raw = spark.createDataFrame([], RAW_SCHEMA)  # every column nullable
    plan = _plan(clean_op(raw, DEFAULT))
    exch = plan.index("Exchange hashpartitioning(transaction_id")
    assert "isnotnull(transaction_id" in plan[exch:]


def test_scan_is_column_pruned(spark, sf_small):
    plan = _plan(transactions_from_tables(spark, sf_small))
    li = re.search(r"FileScan parquet \[(l_[^\]]*)\]", plan)
    assert li and "l_tax" not in li.group(1) and "l_linestatus" not in li.group(1)


def test_top_k_keeps_k_rows_per_task(clean):
    assert "TakeOrderedAndProject" in _plan(kpis.top_customers(clean, CFG))


def test_report_expands_and_no_global_sort(clean):
    plan = _plan(kpi_report(clean.withColumn("is_high_value", clean.quantity * 0), 1, CFG))
    assert plan.count("Expand") == 2  # the grouping sets, and the two distinct counts
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan
