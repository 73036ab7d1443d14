"""What the queries move: texts packed for a shuffle, a source dealt by key once."""

from __future__ import annotations

import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.functions import dealt
from kassa.functions.packing import packed, unpacked
from kassa.operators.normalize import prepare
from kassa.operators.quality import judged_rows
from kassa.plans import catalog
from kassa.schema import RAW_COLUMNS, RAW_SCHEMA
from kassa.session import held
from kassa.sinks import incremental
from kassa.sinks.incremental import apply_batch, read_incremental

TEXTS = ["", None, "a", ":", ",", "1,2:x", "Größe", "日本語", "🙂", "a\nb", "\\", '"', "0", "\u0000"]


def _texts(spark):
    rows = [(i, a, b, TEXTS[(i * 5) % len(TEXTS)], float(i)) for i, (a, b) in
            enumerate((a, b) for a in TEXTS for b in TEXTS)]
    return spark.createDataFrame(rows, "id long, a string, b string, c string, x double")


def test_packed_texts_come_back(spark):
    df = _texts(spark)
    got = unpacked(df.withColumn("p", packed(["a", "b", "c"])).drop("a", "b", "c"), "p", ["a", "b", "c"]).select(df.columns)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in df.collect()}
    raw = spark.createDataFrame([(1, bytearray(b"\xff:\x00")), (2, bytearray(b"\xc3"))], "id int, b binary")
    raw = raw.select("id", F.col("b").cast("string").alias("s"), F.lit("t").alias("t"))    # not UTF-8
    back = unpacked(raw.withColumn("p", packed(["s", "t"])).drop("s", "t"), "p", ["s", "t"])
    assert {(r.id, bytes(r.b)) for r in back.select("id", F.col("s").cast("binary").alias("b")).collect()} == {
        (1, b"\xff:\x00"), (2, b"\xc3")}


def test_dealt_rows_are_the_same_rows_in_place(spark):
    df = _texts(spark).withColumn("k", F.when(F.col("id") % 7 > 0, F.col("id") % 5))
    moved = dealt(df, "k")
    assert moved.schema == df.schema
    assert moved.exceptAll(df).count() == 0 and df.exceptAll(moved).count() == 0
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("RepartitionByExpression", 1)[1].split("\n")[1]
    assert "_texts_" in below and "Project" in below
    grouped = held(moved).groupBy("k").agg(F.min("a"))
    try:
        assert grouped.count() == 6
        assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    finally:
        moved.unpersist()
    few = df.select("id", "a", "x")
    assert dealt(few, "id").exceptAll(few).count() == 0 and dealt(few, "a").count() == few.count()


def test_the_runs_share_one_shuffle_of_whole_rows(spark, sf_small, monkeypatch):
    """A run's dedup finds the held source dealt by its key (the first one once it is held, as it runs)."""
    seen, own = [], catalog.run_pipeline

    def watched(session, raw, *args, **kwargs):
        judged = judged_rows(prepare(raw, catalog.CFG), catalog.CFG, RAW_COLUMNS)
        seen.append(judged._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0])
        return own(session, raw, *args, **kwargs)
    monkeypatch.setattr(catalog, "run_pipeline", watched)
    rows = catalog.queries()["run_records"](spark, sf_small).collect()
    assert sorted((r.scale_label, r.status) for r in rows) == [("cache", "SUCCESS"), ("failed", "ERROR"), ("table", "SUCCESS")]
    assert len(seen) == 3 and all("Aggregate" in plan and "Exchange" not in plan for plan in seen[1:])


def test_lines_cross_the_joins_without_supplier_and_flag(spark, sf_small):
    plan = catalog.transactions_from_tables(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Relation [l_orderkey")[0].rsplit("Join", 1)[1].split("\n", 1)[1]
    project = above.split("Project [", 1)[1].split("\n")[0]
    crossed = [c for c in project.split(", ") if c.startswith(("l_", "cast("))]
    assert "AS l_facts" in project and not any(c.startswith(("l_suppkey", "l_returnflag")) for c in crossed)


# --- the table kept up to date by batches ------------------------------------------

def _raw(spark, rows):
    """Rows of (key, customer, price, month)."""
    return spark.createDataFrame(
        [(k, c, 1, f"a{k}", f"c{k % 3}", p, 1 + k % 4, 0.1, "p" if k % 5 else None, "completed", "N", "m",
          None if m is None else f"2024-{m:02d}-05 00:00:00", False) for k, c, p, m in rows], RAW_SCHEMA)


def _whole(spark, target, rows):
    e = catalog.enriched(_raw(spark, rows))
    want, got = catalog.flag(e, catalog.threshold_row(e)), read_incremental(spark, target)
    return got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def _lots(seed, keys=60, most=90):
    rng = random.Random(seed)
    return [[(rng.randrange(keys), rng.choice([5, 6, None]), rng.choice([2.0, 3.0, -1.0]), rng.choice([1, 2, 3, None]))
             for _ in range(rng.randrange(most // 2, most))] for _ in range(3)]


@pytest.mark.parametrize("seed,rows,bits,files", [(0, 5, 28, 8), (1, 250_000, 2, 8), (2, 3, 3, 0)])
def test_batches_in_parts_by_full_key_sets_and_in_crowded_months(spark, tmp_path, monkeypatch, seed, rows, bits, files):
    """Months split by key, sets of keys in which most bits are set, months put together again."""
    monkeypatch.setattr(incremental, "PART_ROWS", rows)
    monkeypatch.setattr(incremental, "MOST_BITS", bits)
    monkeypatch.setattr(incremental, "MOST_FILES", files)
    target, lots = str(tmp_path / "t"), _lots(seed)
    for lot in lots:
        apply_batch(spark, _raw(spark, lot), target)
    assert _whole(spark, target, sum(lots, []))


@pytest.mark.parametrize("rows", [5, 250_000])
def test_whole_rows_are_shuffled_once(spark, tmp_path, monkeypatch, rows):
    """Decided by narrow rows, then one exchange, whether months are split or not."""
    plans = []
    keep = incremental._by_month
    monkeypatch.setattr(incremental, "PART_ROWS", rows)
    monkeypatch.setattr(incremental, "_by_month", lambda df: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    apply_batch(spark, _raw(spark, [(k, 5, 2.0, 1 + k % 3) for k in range(90)]), str(tmp_path / "t"))
    above = plans[0].split("InMemoryRelation")[0]
    assert len(plans) == 1 and above.count("Exchange") == 1 and "_texts_" in above.split("Exchange", 1)[1]


def test_old_rows_stay_where_they_are(spark, tmp_path, monkeypatch):
    """Of the old rows of touched months those move that may be lost; of the old
    winners those are compared whose key may be in the batch."""
    target = str(tmp_path / "t")
    first = [(k, 5, 2.0, 2 + k % 3) for k in range(3000)]
    second = [(k, 6, 3.0, 1) for k in range(0, 3000, 300)] + [(5000 + k, 6, 3.0, 2 + k % 3) for k in range(9)]
    apply_batch(spark, _raw(spark, first), target)
    moved, compared = [], []
    keep, decide = incremental.dealt, incremental._decided
    monkeypatch.setattr(incremental, "dealt", lambda df, *a, **k: moved.append(
        df.groupBy("_kind").count().collect()) or keep(df, *a, **k))
    monkeypatch.setattr(incremental, "_decided", lambda df, *a: compared.append(df.where("NOT _new").count()) or decide(df, *a))
    assert set(apply_batch(spark, _raw(spark, second), target)) == {(2024, m) for m in (1, 2, 3, 4)}
    old = {r[0]: r[1] for r in moved[0]}[incremental.OLD]
    assert 10 <= old <= 100 and 10 <= compared[0] <= 1000
    assert _whole(spark, target, first + second)


def test_many_batches_leave_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_FILES", 2)
    target, rows = str(tmp_path / "t"), []
    for i in range(5):
        lot = [(100 * i + k, 5, 2.0, 1) for k in range(20)]
        rows += lot
        apply_batch(spark, _raw(spark, lot), target)
    files = glob.glob(f"{target}/winners/year=2024/month=1/*.parquet")
    assert 1 <= len(files) <= incremental.MOST_FILES + 1
    assert _whole(spark, target, rows)


@pytest.mark.parametrize("torn", [(), ("month=1",), ("month=2", "month=3")])
def test_a_torn_batch_is_applied_again(spark, tmp_path, torn):
    """``winners`` is as before the batch, or only some of its months are new."""
    target, before = str(tmp_path / "t"), str(tmp_path / "before")
    first = [(k, 5, 2.0, 1 + k % 3) for k in range(40)]
    second = [(k, 6, 3.0, 1 + (k + 1) % 3) for k in range(20, 60)]
    apply_batch(spark, _raw(spark, first), target)
    shutil.copytree(f"{target}/winners", before)
    apply_batch(spark, _raw(spark, second), target)
    for month in os.listdir(f"{before}/year=2024"):
        if month not in torn:
            shutil.rmtree(f"{target}/winners/year=2024/{month}", ignore_errors=True)
            shutil.copytree(f"{before}/year=2024/{month}", f"{target}/winners/year=2024/{month}")
    apply_batch(spark, _raw(spark, second), target)
    assert _whole(spark, target, first + second)
    assert apply_batch(spark, _raw(spark, second), target) == []
