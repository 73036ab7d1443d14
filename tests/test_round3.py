"""Lazy quantiles, grouped KPIs, one source pass, quarantine, increments, sketches."""

from __future__ import annotations

import os
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.config import DEFAULT, CleanConfig
from kassa.operators import groups, kpis, sketches
from kassa.operators.quantile import exact_quantiles
from kassa.operators.ranks import quantile_row, value_counts
from kassa.plans import catalog
from kassa.plans.run import metrics_frame, profiled_rows, profiles, run_pipeline
from kassa.plans.stages import enriched, flag, threshold_row, thresholds
from kassa.operators.normalize import prepare
from kassa.schema import RAW_COLUMNS, RAW_SCHEMA
from kassa.session import held, holding, scratch_path
from kassa.sinks.files import append_run_metrics, finished, write_csv, write_parquet
from kassa.sinks.incremental import apply_batch, read_incremental
from kassa.sources.csv import reject_report, split_csv
from kassa.sources.generate import generate_transactions
from kassa.sources.metrics import load_run_metrics, read_run_metrics
from kassa.sources.tables import TABLES_CONFIG as CFG
from kassa.sources.tables import transactions_from_tables


class Jobs:
    """The jobs that run inside the block (by a job group's status)."""

    def __init__(self, spark):
        self.sc = spark.sparkContext

    def __enter__(self):
        self.sc.setJobGroup("counted", "counted")
        self.before = len(self.sc.statusTracker().getJobIdsForGroup("counted"))
        return self

    def __exit__(self, *_):
        self.n = len(self.sc.statusTracker().getJobIdsForGroup("counted")) - self.before
        self.sc.setLocalProperty("spark.jobGroup.id", None)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- quantiles as a plan -----------------------------------------------------------

def _brute(values, p):
    values = sorted(values)
    if not values:
        return None
    place = Fraction(len(values) - 1) * Fraction(str(p))
    low = int(place)
    high = min(low + 1, len(values) - 1)
    return Fraction(values[low]) + Fraction(values[high] - values[low]) * (place - low)


@pytest.mark.parametrize("seed,ranges", [(0, None), (1, 1), (2, 7), (3, 200)])
def test_quantile_row_equals_brute_force(spark, seed, ranges):
    rng = random.Random(seed)
    values = [Decimal(rng.randrange(-10 ** 9, 10 ** 9)).scaleb(-6) for _ in range(300)] + [Decimal("5.000000")] * 200
    values += [Decimal("123456789012345678901.000001")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x decimal(38,6)").repartition(5)
    probs = [0.0, 0.5, 0.9, 0.333, 1.0]
    row = quantile_row(value_counts(df, "x"), probs, ranges).first()
    assert row["total"] == len(values)
    for i, p in enumerate(probs):
        q = _brute(values, p)
        assert Fraction(row[f"q_{i}"]) == q, p
        assert row[f"above_{i}"] == sum(Fraction(v) > q for v in values)


def test_quantile_row_of_doubles_and_of_nothing(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, float("nan"), None, -0.0, 0.0)], "x double")
    row = quantile_row(value_counts(df, "x"), [0.5, 0.75]).first()
    assert (row["total"], row["q_0"], row["q_1"]) == (5, 1.0, 2.0)
    empty = quantile_row(value_counts(df.where("x > 100 AND NOT isnan(x)"), "x"), [0.5]).first()
    assert empty["total"] is None and empty["q_0"] is None
    for bad in ([1.5], [0.12345]):
        with pytest.raises(ValueError):
            quantile_row(value_counts(df, "x"), bad)


def test_lazy_threshold_equals_the_eager_one(spark, sf_small):
    e = enriched(transactions_from_tables(spark, sf_small), CFG)
    row, th = threshold_row(e, CFG).first(), thresholds(e, CFG)
    assert (row["high_value"], row["median"]) == (th.high_value, th.median)
    a, b = flag(e, threshold_row(e, CFG)), flag(e, th)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    nothing = e.where("net_revenue < 0")
    assert flag(nothing, threshold_row(nothing, CFG)).count() == 0
    rough = CleanConfig(**{**CFG.__dict__, "quantile_error": 0.01})
    assert threshold_row(e, rough).first()["rows"] == e.count()


@pytest.mark.parametrize("name", ["median_order_value", "p90_threshold", "high_value_flag", "clean_table", "overall_kpis",
                                  "kpi_report"])
def test_queries_build_without_a_job_over_the_data(spark, sf_small, name):
    """Building reads file footers only: no job has a shuffle or reads rows."""
    query = catalog.queries()[name]
    query(spark, sf_small)
    with Jobs(spark) as build:
        df = query(spark, sf_small)
    with Jobs(spark) as footers:
        transactions_from_tables(spark, sf_small)
    assert build.n <= footers.n
    assert "l_orderkey" in _plan(df)


@pytest.mark.parametrize("name", ["clean_table", "high_value_flag"])
def test_the_flag_reads_the_held_rows(spark, sf_small, name):
    """The rows and their threshold read one held frame; no branch reads lineitem beside it."""
    df = catalog.queries()[name](spark, sf_small)
    plan = df._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation") > 1 and "Relation [l_" not in plan


@pytest.mark.parametrize("name", ["overall_kpis", "kpi_report"])
def test_the_report_scans_lineitem_once(spark, sf_small, name):
    """In the plan that ran, one branch scans and the others reuse its exchange."""
    df = catalog.queries()[name](spark, sf_small)
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("FileScan parquet [l_") == 1 and "ReusedExchange" in ran


def test_a_held_frame_answers_no_other_query(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    with holding() as frames:
        assert held(spark.read.parquet(path)).count() == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert len(frames) == 1 and spark.read.parquet(path).count() == 5
    assert held(spark.read.parquet(path)).count() == 5


# --- grouped KPIs ------------------------------------------------------------------

@pytest.mark.parametrize("drop", [False, True])
def test_grouped_families_equal_their_own_queries(spark, sf_small, drop):
    cfg = CleanConfig(**{**CFG.__dict__, "drop_null_keys": drop})
    e = enriched(transactions_from_tables(spark, sf_small), cfg)
    e = e.withColumns({c: F.when(F.col("transaction_id") % 31 != 0, F.col(c)) for c in ("payment_method", "year")}).cache()
    th = thresholds(e, cfg)
    clean = flag(e, th)
    for rows in (e, clean):               # with the flag, or by the threshold
        grouped = groups.kpi_groups(rows, cfg).cache()
        assert groups.overall_of_rows(rows, cfg).first() == kpis.overall(clean, th.median, cfg).first()
        assert groups.overall(grouped, cfg).first() == kpis.overall(clean, th.median, cfg).first()
        lines = groups.report_rows(grouped, cfg).collect()
        by = {}
        for r in lines:
            by.setdefault((r.section, r.metric), {})[r.position] = (r.key, r.value)
        want = [r[0] for r in kpis.payment_method_revenue(clean, cfg).select("payment_method").collect()]
        got = by[("payment_method_revenue", "net_revenue")]
        assert [got[i + 1][0] for i in range(len(got))] == want and (None in want) != drop
        bands = {r.revenue_band: r.pct for r in kpis.revenue_band_dist(clean, cfg).collect()}
        assert {k: v for k, v in by[("revenue_band_dist", "pct")].values()} == bands
        top = [(str(r[0]), r[1]) for r in kpis.top_customers(clean, cfg).collect()]
        assert [by[("top_customers", "net_revenue")][i + 1] for i in range(len(top))] == top
        grouped.unpersist()
    e.unpersist()


def test_groups_of_nothing(spark, sf_small):
    e = enriched(transactions_from_tables(spark, sf_small), CFG).where("net_revenue < 0")
    grouped = groups.kpi_groups(e, CFG)
    row = groups.overall(grouped, CFG).first()
    assert row["total_transactions"] == 0 and row["median_order_value"] == 0.0 and row["high_value_txn_pct"] == 0.0
    lines = groups.report_rows(grouped, CFG).collect()
    assert {r.section for r in lines} == {"overall", "revenue_band_dist"}


# --- the run -----------------------------------------------------------------------

def test_profiles_come_with_the_staged_rows(spark):
    rows = [(1, 5, 1, "a", "c", 2.0, 1, 0.0, "p", "completed", "N", "m", "2024-01-02 00:00:00", False)] * 3
    rows += [(None, 5, 1, None, "c", 2.0, 1, None, "p", "completed", "N", "m", "2024-01-02 00:00:00", False)] * 2
    rows += [(2, None, 1, "a", "c", float("nan"), 1, 0.0, None, "completed", "N", "m", "bad", False)]
    raw = spark.createDataFrame(rows, RAW_SCHEMA).repartition(3)
    staged = profiled_rows(prepare(raw, DEFAULT), DEFAULT, RAW_COLUMNS)
    before, after = profiles(staged)
    assert before == {"rows": 6, "nulls": 2 * 3 + 4} and after == {"rows": 1, "nulls": 0}


def test_a_run_reads_its_source_once(spark, tmp_path):
    """Counted by the source itself: every row adds one, in a run without retries."""
    raw = generate_transactions(spark, 400)
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    seen = raw.mapInArrow(count, raw.schema)
    result = run_pipeline(spark, seen, str(tmp_path / "run"), "once", DEFAULT)
    assert result.metrics["raw_rows"] == 400 and reads.value == 400


def test_appending_again_replaces_the_run(spark, tmp_path):
    path = str(tmp_path / "m")
    row = lambda i, s: {"run_id": i, "framework": "kassa", "scale_label": "x", "status": s}
    append_run_metrics(metrics_frame(spark, [row("a1", "ERROR"), row("0012", "SUCCESS")]), path)
    append_run_metrics(metrics_frame(spark, [row("a1", "SUCCESS")]), path)
    append_run_metrics(metrics_frame(spark, [row("1e5", "SUCCESS")]), path)
    for runs in (read_run_metrics(spark, path, None, multiline=False), load_run_metrics(spark, path)):
        assert sorted((r.run_id, r.status) for r in runs.collect()) == [
            ("0012", "SUCCESS"), ("1e5", "SUCCESS"), ("a1", "SUCCESS")]


# --- sinks and sources ---------------------------------------------------------------

@pytest.mark.parametrize("write", [write_csv, lambda df, p: write_parquet(df, p, mode="ignore")])
def test_only_a_finished_target_is_skipped(spark, tmp_path, write):
    path = str(tmp_path / "t")
    write(spark.range(10), path)
    assert finished(spark, path)
    write(spark.range(3), path)
    read = lambda: (spark.read.option("header", True).csv(path) if write is write_csv else spark.read.parquet(path)).count()
    assert read() == 10
    os.remove(f"{path}/_SUCCESS")
    write(spark.range(3), path)
    assert read() == 3 and finished(spark, path)


def test_rejects_keep_line_file_and_reason(spark, tmp_path):
    src, schema = tmp_path / "in", T.StructType([
        T.StructField("transaction_id", T.LongType()), T.StructField("product_name", T.StringType()),
        T.StructField("price", T.DoubleType()), T.StructField("quantity", T.IntegerType())])
    src.mkdir()
    (src / "a.csv").write_text('transaction_id,product_name,price,quantity\n1,ok,2.5,3\n2,"torn\nname",2.5,3\n3,x,abc,3\n'
                               '4,x,1e30,3\n5,x,NaN,NA\n6,x,2.5\n7,"a ""b"", c",2.5,4\n8,x,inf,1\n9,,2.0,2.7\n')
    accepted, rejected = split_csv(spark, str(src), str(tmp_path / "out"), schema)
    assert sorted(accepted.collect()) == [(1, "ok", 2.5, 3), (5, "x", None, None), (7, 'a "b", c', 2.5, 4)] or \
        sorted((r[0], r[1], r[3]) for r in accepted.collect()) == [(1, "ok", 3), (5, "x", None), (7, 'a "b", c', 4)]
    got = sorted((r.reason, r.line) for r in rejected.collect())
    assert [r for r, _ in got] == ["columns"] * 3 + ["range price"] * 2 + ["type price", "type quantity"]
    assert any(line.startswith('2,"torn') for _, line in got) and ("type price", "3,x,abc,3") in got
    assert all(r.file.endswith("a.csv") for r in rejected.collect())
    report = {r.reason: r.rows for r in reject_report(accepted, rejected).collect()}
    assert report == {None: 3, "columns": 3, "range price": 2, "type price": 1, "type quantity": 1}
    whole, torn = split_csv(spark, str(src), str(tmp_path / "out2"), schema, multi_line=True)
    assert (2, "torn\nname") in [(r[0], r[1]) for r in whole.collect()] and torn.where("reason = 'columns'").count() == 1


@pytest.mark.parametrize("seed", [0, 1])
def test_batches_equal_one_whole_run(spark, tmp_path, seed):
    """Random batches over few keys, so that rows move between months, winners
    change and partitions become empty; a batch that was torn is run again."""
    rng = random.Random(seed)
    months = ["2024-01-05 00:00:00", "2024-02-05 00:00:00", "2024-03-05 00:00:00", "bad", None]
    rows = [(rng.randrange(12), rng.choice([5, 5, 5, None]), 1, rng.choice(["a", None]), "c", rng.choice([2.0, 3.0, -1.0]),
             rng.randrange(1, 4), 0.1, "p", "completed", "N", "m", rng.choice(months), False) for _ in range(60)]
    raw = lambda rs: spark.createDataFrame(rs, RAW_SCHEMA)
    target, lots = str(tmp_path / "t"), [rows[:4], rows[4:20], rows[20:21], rows[20:45], rows[45:], rows[45:]]
    touched = [apply_batch(spark, raw(lot), target, DEFAULT) for lot in lots]
    assert touched[-1] == []
    e = enriched(raw(rows), DEFAULT)
    want = flag(e, threshold_row(e, DEFAULT))
    got = read_incremental(spark, target, DEFAULT)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_batch_touches_only_its_months(spark, tmp_path):
    row = lambda k, month: (k, 5, 1, "a", "c", 2.0, 1, 0.1, "p", "completed", "N", "m", f"2024-{month:02d}-05 00:00:00", False)
    target = str(tmp_path / "t")
    apply_batch(spark, spark.createDataFrame([row(k, 1 + k % 6) for k in range(30)], RAW_SCHEMA), target, DEFAULT)
    stamp = lambda: {d: max(os.stat(f"{target}/clean/year=2024/{d}/{f}").st_mtime_ns for f in os.listdir(f"{target}/clean/year=2024/{d}"))
                     for d in os.listdir(f"{target}/clean/year=2024")}
    before = stamp()
    months = apply_batch(spark, spark.createDataFrame([row(100, 2), row(4, 1)], RAW_SCHEMA), target, DEFAULT)
    after = stamp()
    assert set(months) == {(2024, 2), (2024, 1), (2024, 5)}      # key 4 moves from May to January
    assert {d for d in before if after[d] == before[d]} == {"month=3", "month=4", "month=6"}


def test_sketches_merge_like_their_days(spark):
    rows = spark.range(20000).selectExpr(
        "timestampadd(DAY, CAST(id % 40 AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS timestamp",
        "id % 3000 AS customer_id", "id % 50 AS product_id", "CAST(id AS DECIMAL(38,6)) AS net_revenue")
    days = sketches.daily_sketches(rows).cache()
    assert days.count() == 40
    one = sketches.merged(days).first()
    assert one["transactions"] == 20000 and abs(one["unique_customers"] - 3000) <= 3 * sketches.HLL_ERROR * 3000
    assert one["unique_products"] == 50
    assert abs(one["p50"] / 20000 - 0.5) < 0.02 and abs(one["p90"] / 20000 - 0.9) < 0.02
    part = sketches.merged(days.where("day < DATE'2024-01-11'"), F.month("day").alias("month")).first()
    assert part["transactions"] == 5000
