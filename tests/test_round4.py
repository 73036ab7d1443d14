"""What the queries shuffle: held sources, narrow comparisons, stored groups."""

from __future__ import annotations

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kassa.config import DEFAULT
from kassa.operators import groups
from kassa.operators.normalize import prepare
from kassa.operators.quality import judged_rows
from kassa.plans import catalog
from kassa.schema import RAW_COLUMNS, RAW_SCHEMA
from kassa.sinks import incremental
from kassa.sinks.incremental import apply_batch, read_incremental


def _raw(spark, rows):
    """Rows of (key, customer, price, month)."""
    return spark.createDataFrame(
        [(k, c, 1, f"a{k}", f"c{k % 3}", p, 1 + k % 4, 0.1, "p" if k % 5 else None, ("completed", "cancelled")[k % 2], "N", "m",
          f"2024-{m:02d}-05 00:00:00", False) for k, c, p, m in rows], RAW_SCHEMA)


@pytest.mark.parametrize("name", ["incremental_clean", "run_records"])
def test_the_source_is_joined_once(spark, sf_small, name, monkeypatch):
    """Every batch and run reads one held source: none has joins of its own."""
    built, seen = [], []
    whole = catalog.transactions_from_tables
    monkeypatch.setattr(catalog, "transactions_from_tables", lambda *a: built.append(1) or whole(*a))
    target = "apply_batch" if name == "incremental_clean" else "run_pipeline"
    own = getattr(catalog, target)

    def watched(session, raw, *args, **kwargs):
        seen.append(raw._jdf.queryExecution().withCachedData().toString())
        return own(session, raw, *args, **kwargs)
    monkeypatch.setattr(catalog, target, watched)
    catalog.queries()[name](spark, sf_small)
    assert len(built) == 1 and len(seen) == 3
    assert all("InMemoryRelation" in plan and "Relation [l_" not in plan for plan in seen)


def test_only_the_deciding_columns_of_old_winners_are_compared(spark, tmp_path, monkeypatch):
    """A batch that changes nothing reads neither text nor amounts of the old winners."""
    cfg = catalog.CFG
    tx = lambda: _raw(spark, [(k, 5, 2.0, 1 + k % 3) for k in range(40)]).withColumn(catalog.TIE_BREAK_COLUMN, F.lit(1.0))
    target, plans = str(tmp_path / "t"), []
    apply_batch(spark, tx(), target, cfg)
    keep = incremental.held
    monkeypatch.setattr(incremental, "held", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    assert apply_batch(spark, tx(), target, cfg) == []
    assert len(plans) == 1
    scans = re.findall(r"Relation \[(.*?)\] parquet", plans[0])
    assert len(scans) == 1
    read = plans[0].rsplit("+- ", 1)[0]
    assert "category" in scans[0] and not re.search(r"Project \[[^\n]*product_name#[^\n]*\n[^\n]*(Filter[^\n]*\n[^\n]*)?Relation", read)


def test_batches_give_one_table_and_one_shuffle_by_month(spark, tmp_path, monkeypatch):
    dealt = []
    keep = incremental._by_month
    monkeypatch.setattr(incremental, "_by_month", lambda df: dealt.append(1) or keep(df))
    first = [(k, 5, 2.0, 1 + k % 3) for k in range(60)]
    second = [(k, None if k % 7 == 0 else 6, 3.0, 1 + k % 2) for k in range(30, 90)]
    target = str(tmp_path / "t")
    for rows in (first, second, second):
        apply_batch(spark, _raw(spark, rows), target)
    assert len(dealt) == 2                       # the third batch changes nothing
    e = catalog.enriched(_raw(spark, first + second))
    want = catalog.flag(e, catalog.threshold_row(e))
    got = read_incremental(spark, target)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stored_groups_are_the_same_groups(spark, tmp_path):
    rows = catalog.enriched(_raw(spark, [(k, k % 11, 2.0 + k % 13, 1 + k % 6) for k in range(300)]))
    rows.withColumn("is_high_value", (F.col("net_revenue") > 20).cast("int")).write.parquet(str(tmp_path / "t"))
    for stored in (spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "t")).where("net_revenue < 0"),
                   spark.read.parquet(str(tmp_path / "t")).drop("is_high_value")):
        old, new = groups.kpi_groups(stored), groups.stored_groups(stored)
        assert {f.name: f.dataType for f in old.schema} == {f.name: f.dataType for f in new.schema}
        for name, has in groups.APART.items():   # what no family reads of these sets is null
            old = old.withColumns({c: F.when(F.col("set") != name, F.col(c)) for c in ("net", "gross", "discounts", "discount_sum", "high")
                                   if c in old.columns and c not in has})
        new = new.select(old.columns)
        assert old.exceptAll(new).count() == 0 and new.exceptAll(old).count() == 0
        lines = lambda g: sorted(map(tuple, groups.report_rows(g, DEFAULT, Decimal(3)).collect()), key=str) \
            if "high" in g.columns else sorted(map(tuple, groups.report_rows(g).collect()), key=str)
        assert lines(groups.stored_groups(stored)) == lines(groups.kpi_groups(stored))


def test_stored_groups_expand_no_rows(spark, tmp_path):
    rows = catalog.enriched(_raw(spark, [(k, k % 11, 2.0, 1) for k in range(20)]))
    rows.write.parquet(str(tmp_path / "t"))
    plan = groups.stored_groups(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Expand", 1)[1]
    assert plan.count("Expand") == 1 and below.index("Aggregate") < below.index("Relation")


def test_judged_rows_carry_every_cell_once(spark):
    raw = prepare(_raw(spark, [(1, 5, 2.0, 3), (1, 7, 3.0, 2), (2, None, 2.0, 1)]))
    judged = judged_rows(raw, DEFAULT, RAW_COLUMNS)
    assert [(r.transaction_id, r.customer_id, r._rows, r._kept) for r in judged.orderBy("transaction_id").collect()] == [
        (1, 7, 2, True), (2, None, 1, False)]
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and judged.columns[2:16] == list(RAW_COLUMNS)
