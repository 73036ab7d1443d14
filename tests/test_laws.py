"""Laws of the cleaning and KPI stages on the derived test transactions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kassa.operators import kpis
from kassa.operators.replicate import replicate
from kassa.plans.stages import enriched
from kassa.sources.tables import TABLES_CONFIG as CFG
from kassa.sources.tables import transactions_from_tables


@pytest.fixture(scope="module")
def tx(spark, sf_small):
    return transactions_from_tables(spark, sf_small)


@pytest.fixture(scope="module")
def clean(tx):
    df = enriched(tx, CFG).cache()
    yield df
    df.unpersist()  # later modules inspect the uncached plan


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_golden_counts(tx, clean):
    assert tx.count() == 6000
    assert clean.count() == 4184
    totals = clean.agg(F.sum("gross_revenue"), F.sum("discount_amt"), F.sum("net_revenue")).first()
    assert [round(float(v), 2) for v in totals] == [1188447.99, 51319.01, 1137128.98]


def test_keys_unique_and_rules_hold(clean):
    assert clean.select("transaction_id").distinct().count() == clean.count()
    bad = clean.where((F.col("net_revenue") != F.col("gross_revenue") - F.col("discount_amt"))
                      | (F.col("discount") < 0) | (F.col("discount") > 1)
                      | (F.col("price") <= 0) | (F.col("quantity") <= 0))
    assert bad.count() == 0


def test_idempotent_under_replication(tx, clean):
    again = enriched(replicate(tx, 3), CFG)
    assert _rows(again) == _rows(clean)


def test_independent_of_partitioning_and_order(tx, clean):
    shuffled = tx.repartition(13, F.rand(5)).sortWithinPartitions(F.rand(9))
    assert _rows(enriched(shuffled, CFG)) == _rows(clean)


def test_breakdowns_add_up(clean):
    total = clean.agg(F.sum("net_revenue").alias("s")).first()["s"]
    n = clean.count()
    for table in (kpis.category_revenue(clean, CFG), kpis.region_performance(clean, CFG),
                  kpis.payment_method_revenue(clean, CFG), kpis.monthly_trend(clean, CFG)):
        rows = table.collect()  # each group is rounded to 2 places: 0.005 per group
        assert abs(sum(r["net_revenue"] for r in rows) - float(total)) <= 0.005 * len(rows) + 1e-6
    bands = kpis.revenue_band_dist(clean, CFG).collect()
    assert sum(r["transactions"] for r in bands) == n
    assert abs(sum(r["pct"] for r in bands) - 100.0) < 0.05
    assert sum(r["transactions"] for r in kpis.status_counts(clean, CFG).collect()) == n


def test_top_customers_order(clean):
    top = kpis.top_customers(clean, CFG).collect()
    assert len(top) == 10
    nets = [r["net_revenue"] for r in top]
    assert nets == sorted(nets, reverse=True)
    best = (clean.groupBy("customer_id").agg(F.sum("net_revenue").alias("s"))
            .orderBy(F.desc("s")).first())
    assert top[0]["customer_id"] == best["customer_id"]
