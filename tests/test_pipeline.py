"""End-to-end run: stages, written outputs, report, run metrics, errors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kassa.operators import kpis
from kassa.operators.report import kpi_report
from kassa.plans.run import run_pipeline
from kassa.plans.stages import enriched, flag, thresholds
from kassa.schema import CLEAN_COLUMNS
from kassa.session import scratch_path
from kassa.sources.metrics import read_run_metrics
from kassa.sources.tables import TABLES_CONFIG as CFG
from kassa.sources.tables import transactions_from_tables


@pytest.fixture(scope="module")
def run(spark, sf_small):
    target = scratch_path(spark, "pipeline")
    metrics = scratch_path(spark, "metrics")
    result = run_pipeline(spark, transactions_from_tables(spark, sf_small), target, "sf0.001",
                          CFG, metrics_path=metrics, kpi_tables_path=f"{target}/kpis", document=True)
    return result, metrics


def test_metrics_and_quality(run):
    result, _ = run
    m = result.metrics
    assert m["status"] == "SUCCESS"
    assert m["raw_rows"] == 6000 and m["clean_rows"] == 4184
    q = m["quality"]
    assert q["rows_before"] == 6000 and q["rows_after"] == 4184 and q["rows_dropped"] == 1816
    assert q["drop_pct"] == 30.27
    assert q["null_rate_after"] == 0.0
    assert all(m[f"time_{s}_s"] >= 0 for s in ("extract", "transform", "load", "analytics"))


def test_written_clean_table(spark, run, sf_small):
    result, _ = run
    written = spark.read.parquet(result.clean_path)
    assert written.columns == list(CLEAN_COLUMNS)
    e = enriched(transactions_from_tables(spark, sf_small), CFG)
    expected = flag(e, thresholds(e, CFG))
    assert written.exceptAll(expected).count() == 0 and expected.exceptAll(written).count() == 0


def test_report_matches_kpi_tables(spark, run):
    result, _ = run
    clean = spark.read.parquet(result.clean_path)
    rep = kpi_report(clean, result.thresholds.median, CFG).first()
    o = kpis.overall(clean, result.thresholds.median, CFG).first().asDict()
    for k, v in o.items():
        assert rep[k] == v, k
    cat = [tuple(r) for r in kpis.category_revenue(clean, CFG).collect()]
    assert [tuple(r) for r in rep["category_revenue"]] == cat
    month = [tuple(r) for r in kpis.monthly_trend(clean, CFG).collect()]
    assert [tuple(r) for r in rep["monthly_trend"]] == month
    reg = [tuple(r) for r in kpis.region_performance(clean, CFG).collect()]
    assert [tuple(r) for r in rep["region_performance"]] == reg
    pay = [tuple(r) for r in kpis.payment_method_revenue(clean, CFG).collect()]
    assert [tuple(r) for r in rep["payment_method_revenue"]] == pay
    top = [tuple(r) for r in kpis.top_customers(clean, CFG).collect()]
    assert [tuple(r) for r in rep["top_10_customers"]] == top
    bands = [(r["revenue_band"], r["pct"]) for r in kpis.revenue_band_dist(clean, CFG).collect()]
    assert [tuple(r) for r in rep["revenue_band_dist"]] == bands
    # and the JSON document written by the run holds the same numbers
    doc = result.report.first()
    assert doc["total_net_revenue"] == rep["total_net_revenue"] == 1137128.98


def test_run_metrics_history(spark, run):
    _, metrics = run
    hist = read_run_metrics(spark, metrics, pattern=None, multiline=False)
    row = hist.first()
    assert row["status"] == "SUCCESS" and row["quality"]["rows_after"] == 4184


def test_error_is_recorded(spark):
    bad = spark.range(3).select(F.col("id").alias("transaction_id"))  # columns missing
    metrics = scratch_path(spark, "metrics-err")
    result = run_pipeline(spark, bad, scratch_path(spark, "bad"), "bad", CFG,
                          metrics_path=metrics, raise_errors=False)
    assert result.metrics["status"] == "ERROR" and result.metrics["error_msg"]
    hist = read_run_metrics(spark, metrics, pattern=None, multiline=False)
    assert hist.first()["status"] == "ERROR"
    with pytest.raises(Exception):
        run_pipeline(spark, bad, scratch_path(spark, "bad2"), "bad", CFG)


def test_kpi_tables_written(spark, run):
    result, _ = run
    base = result.clean_path.rsplit("/", 1)[0] + "/kpis"
    cat = spark.read.parquet(f"{base}/category_revenue")
    assert cat.count() == 6 and "avg_discount" in cat.columns
    assert spark.read.parquet(f"{base}/top_customers").count() == 10


def test_table_staging_gives_the_same_result(spark, run, sf_small):
    result, _ = run
    other = run_pipeline(spark, transactions_from_tables(spark, sf_small),
                         scratch_path(spark, "pipeline-table"), "sf0.001", CFG, staging="table")
    assert other.metrics["quality"] == result.metrics["quality"]
    a = spark.read.parquet(result.clean_path)
    b = spark.read.parquet(other.clean_path)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_everything_dropped_gives_zero_kpis(spark):
    from kassa.config import DEFAULT
    from kassa.sources.generate import generate_transactions
    raw = generate_transactions(spark, 200).withColumn("price", -F.col("price"))
    result = run_pipeline(spark, raw, scratch_path(spark, "empty"), "empty", DEFAULT, document=True)
    m = result.metrics
    assert m["status"] == "SUCCESS" and m["clean_rows"] == 0
    assert m["quality"]["drop_pct"] == 100.0 and m["quality"]["null_rate_after"] == 0.0
    doc = result.report.first()
    assert doc["total_transactions"] == 0 and doc["total_net_revenue"] == 0.0
    assert doc["median_order_value"] == 0.0 and doc["cancellation_rate"] == 0.0


def test_statically_empty_input(spark):
    from kassa.config import DEFAULT
    from kassa.sources.generate import generate_transactions
    raw = generate_transactions(spark, 50).withColumn("price", F.lit(-1.0))  # folded away
    result = run_pipeline(spark, raw, scratch_path(spark, "folded"), "folded", DEFAULT)
    assert result.metrics["raw_rows"] == 50 and result.metrics["clean_rows"] == 0
