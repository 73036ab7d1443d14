"""The hand-made edge table: one row per boundary or divergence rule."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kassa.config import DEFAULT
from kassa.operators import kpis
from kassa.operators.clean import clean, dedup, drop_critical_nulls
from kassa.operators.dedup import exact_dedup
from kassa.operators.enrich import enrich
from kassa.operators.normalize import prepare
from kassa.operators.quality import null_profile, quality_report
from kassa.plans.stages import flag, thresholds
from kassa.schema import CLEAN_COLUMNS, RAW_COLUMNS
from kassa.sources.csv import read_transactions_csv

EDGE_CSV = """transaction_id,customer_id,product_id,product_name,category,price,quantity,discount,payment_method,status,region,device_type,timestamp,is_duplicate_flag
1,1001,101,Alpha,Books,25.00,2,0.0,upi,completed,North,mobile,2024-01-01 10:00:00,False
1,1001,101,Alpha,Books,25.00,2,0.0,upi,completed,North,mobile,2024-01-01 10:00:00,False
1,1001,101,Alpha,Books,25.00,2,0.0,upi,pending,North,mobile,2024-01-01 09:00:00,False
2,1002,102,None,Toys,19.99,3,,paypal,completed,South,desktop,2024-02-29 00:00:00.123,False
3,,103,Beta,Toys,10.00,1,0.1,cod,completed,East,tablet,2024-01-02 00:00:00,False
3,1003,103,Beta,Toys,10.00,1,0.1,cod,completed,East,tablet,2024-01-03 00:00:00,False
4,1004,104,Gamma,Sports,-5.00,1,0.0,cod,completed,West,mobile,2024-01-04 00:00:00,False
5,1005,105,Delta,Sports,5.00,0,0.0,cod,completed,West,mobile,2024-01-05 00:00:00,False
6,1006,106,Epsilon,Health,400.00,1,1.5,,refunded,West,mobile,bad,False
7,1007,107,Zeta,Beauty,Infinity,1,0.0,upi,completed,Central,mobile,2024-01-07 00:00:00,False
8,1008,108,Eta,Beauty,NaN,1,0.0,upi,completed,Central,mobile,2024-01-08 00:00:00,False
9,1009,109,Theta,Grocery,125.00,4,-0.2,debit_card,cancelled,North,desktop,2024-12-30 23:59:59,True
10,1010,110,Iota,Grocery,500.00,2,0.0,credit_card,completed,North,desktop,2024-03-31 00:00:00,False
x,1011,111,Kappa,Books,30.00,1,0.0,upi,completed,East,mobile,2024-01-11 00:00:00,False
"""


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edge") / "edge.csv"
    path.write_text(EDGE_CSV)
    return read_transactions_csv(spark, str(path))


@pytest.fixture(scope="module")
def prepared(raw):
    return prepare(raw, DEFAULT)


@pytest.fixture(scope="module")
def clean_table(prepared):
    e = enrich(clean(prepared, DEFAULT), DEFAULT)
    th = thresholds(e, DEFAULT)
    return flag(e, th), th


def test_row_counts_per_stage(raw, prepared):
    assert raw.count() == 14
    assert exact_dedup(raw).count() == 13
    by_key = dedup(prepared, DEFAULT)
    assert by_key.count() == 11
    assert drop_critical_nulls(by_key, DEFAULT.critical).count() == 8
    assert clean(prepared, DEFAULT).count() == 5


def test_clean_rows(clean_table):
    ct, _ = clean_table
    rows = {r["transaction_id"]: r for r in ct.collect()}
    assert sorted(rows) == [1, 2, 6, 9, 10]
    assert {k: r["net_revenue"] for k, r in rows.items()} == {
        1: Decimal("50.000000"), 2: Decimal("59.970000"), 6: Decimal("0.000000"),
        9: Decimal("500.000000"), 10: Decimal("1000.000000")}
    assert {k: r["revenue_band"] for k, r in rows.items()} == {
        1: "low", 2: "low", 6: "micro", 9: "high", 10: "premium"}
    assert {k: r["dow"] for k, r in rows.items()} == {1: 2, 2: 5, 6: None, 9: 2, 10: 1}
    assert {k: r["is_high_value"] for k, r in rows.items()} == {1: 0, 2: 0, 6: 0, 9: 0, 10: 1}
    # earliest copy of id 1 wins; NA token filled; sub-second tail cut; clip
    assert rows[1]["status"] == "pending"
    assert rows[2]["product_name"] == "Unknown Product"
    assert rows[2]["discount"] == 0.0
    assert rows[2]["timestamp"] == dt.datetime(2024, 2, 29)
    assert rows[6]["timestamp"] is None and rows[6]["payment_method"] is None
    assert rows[6]["discount"] == 1.0 and rows[9]["discount"] == 0.0
    assert list(ct.columns) == list(CLEAN_COLUMNS)


def test_quantiles(clean_table):
    _, th = clean_table
    assert th.high_value == Decimal("800")
    assert th.median == Decimal("59.97")


def test_kpis(clean_table):
    ct, th = clean_table
    o = kpis.overall(ct, th.median, DEFAULT).first().asDict()
    assert o["total_transactions"] == 5
    assert o["total_gross_revenue"] == 2009.97
    assert o["total_discount_amt"] == 400.0
    assert o["total_net_revenue"] == 1609.97
    assert o["avg_order_value"] == 321.99
    assert o["median_order_value"] == 59.97
    assert o["cancellation_rate"] == 20.0 and o["refund_rate"] == 20.0
    assert o["high_value_txn_pct"] == 20.0
    bands = {r["revenue_band"]: r["pct"] for r in kpis.revenue_band_dist(ct, DEFAULT).collect()}
    assert bands == {"micro": 20.0, "low": 40.0, "medium": 0.0, "high": 20.0, "premium": 20.0}
    pay = {r["payment_method"]: r["net_revenue"]
           for r in kpis.payment_method_revenue(ct, DEFAULT).collect()}
    assert pay[None] == 0.0  # a null method is its own group


def test_quality(prepared, clean_table):
    ct, _ = clean_table
    q = quality_report(prepared, ct, RAW_COLUMNS, CLEAN_COLUMNS).first().asDict()
    assert q == {"rows_before": 14, "rows_after": 5, "rows_dropped": 9, "drop_pct": 64.29,
                 "null_rate_before": 3.5714, "null_rate_after": 5.2174}
    prof = null_profile(prepared, RAW_COLUMNS).first()
    assert prof["null_cells"] == 7 and prof["null_price"] == 1  # NaN is a missing cell


def test_monday_week_start(clean_table):
    ct, _ = clean_table
    from dataclasses import replace
    from kassa.operators.enrich import calendar_parts
    cfg = replace(DEFAULT, week_start="monday")
    dows = {r["transaction_id"]: r["dow"] for r in calendar_parts(ct, cfg).collect()}
    assert dows == {1: 0, 2: 3, 6: None, 9: 0, 10: 6}


def test_drop_null_keys_option(clean_table):
    ct, _ = clean_table
    from dataclasses import replace
    cfg = replace(DEFAULT, drop_null_keys=True)
    methods = [r["payment_method"] for r in kpis.payment_method_revenue(ct, cfg).collect()]
    assert None not in methods and len(methods) == 4


def test_approximate_threshold(clean_table):
    from dataclasses import replace
    ct, _ = clean_table
    cfg = replace(DEFAULT, quantile_error=0.001)
    th = thresholds(ct.drop("is_high_value"), cfg)
    assert float(th.high_value) in (500.0, 1000.0)  # an observed value near p90
    assert ct.where(F.col("net_revenue") > F.lit(th.median)).count() >= 1
