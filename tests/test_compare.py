"""Run comparison over a stored run history (published runs plus a failure)."""

from __future__ import annotations

import pytest

from kassa.operators import compare
from kassa.plans.run import metrics_frame


def _run(fw, label, raw, total, stages, drop=0.0, nb=0.0, status="SUCCESS"):
    ex, tr, lo, an = stages
    return {"framework": fw, "scale_label": label, "status": status, "raw_rows": raw,
            "clean_rows": raw, "cores_used": 1 if fw == "pandas" else 12,
            "time_extract_s": ex, "time_transform_s": tr, "time_load_s": lo,
            "time_analytics_s": an, "time_total_s": total, "memory_peak_mb": 150.0,
            "quality": {"rows_before": raw, "rows_after": raw, "rows_dropped": 0,
                        "drop_pct": drop, "null_rate_before": nb, "null_rate_after": 0.0}}


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        _run("pandas", "10K", 10_000, 0.254, (0.044, 0.054, 0.111, 0.043), nb=0.16),
        _run("pandas", "100K", 100_000, 0.595, (0.293, 0.119, 0.128, 0.053), nb=0.14),
        _run("pandas", "1M", 1_000_000, 5.928, (3.559, 1.337, 0.783, 0.242), nb=0.14),
        _run("pandas", "10M", 10_000_000, 102.001, (34.906, 57.206, 7.199, 1.579),
             drop=66.67, nb=0.14),
        _run("pyspark", "10K", 10_000, 19.681, (3.504, 7.301, 1.746, 6.842)),
        _run("pyspark", "100K", 100_000, 9.828, (0.221, 4.165, 1.096, 4.201)),
        _run("pyspark", "1M", 1_000_000, 22.323, (0.248, 13.889, 2.625, 5.321)),
        _run("pyspark", "10M", 10_000_000, 124.396, (4.844, 92.656, 11.547, 13.947)),
        {"framework": "pandas", "scale_label": "20M", "status": "FAILED (OOM)",
         "time_total_s": -1.0, "memory_peak_mb": 14000.0},
        _run("pyspark", "20M", 20_000_000, 250.0, (9.0, 180.0, 30.0, 31.0)),
    ]
    return metrics_frame(spark, rows)


def test_speedup(runs):
    rows = {r["scale_label"]: r for r in compare.speedup(runs).collect()}
    assert rows["10M"]["speedup"] == pytest.approx(102.001 / 124.396)
    assert rows["10M"]["mark"] == "slower"
    assert rows["20M"]["speedup"] is None and rows["20M"]["mark"] is None  # failed baseline
    assert [r["scale_label"] for r in compare.speedup(runs).collect()] == [
        "10K", "100K", "1M", "10M", "20M"]


def test_throughput(runs):
    rows = {(r["framework"], r["scale_label"]): r["k_rows_per_s"]
            for r in compare.throughput(runs).collect()}
    assert rows[("pandas", "1M")] == pytest.approx(1_000_000 / 5.928 / 1000)
    assert ("pandas", "20M") not in rows


def test_stage_breakdown_picks_largest_by_rows(runs):
    rows = compare.stage_breakdown(runs).collect()
    assert {r["scale_label"] for r in rows} == {"20M"}  # not "1M" by text order
    assert {r["stage"] for r in rows} == {"extract", "transform", "load", "analytics"}
    one = {(r["framework"], r["stage"]): r["seconds"]
           for r in compare.stage_breakdown(runs, "10M").collect()}
    assert one[("pyspark", "transform")] == 92.656


def test_summary_and_quality(runs):
    summ = {(r["framework"], r["scale_label"]): r for r in compare.summary_table(runs).collect()}
    failed = summ[("pandas", "20M")]
    assert failed["status"] == "FAILED (OOM)" and failed["time_total_s"] is None
    assert failed["memory_peak_mb"] == 14000.0
    q = {(r["framework"], r["scale_label"]): r for r in compare.quality_series(runs).collect()}
    assert q[("pandas", "10M")]["drop_pct"] == 66.67
    ranked = [r["time_total_s"] for r in compare.ranked_runs(runs).collect()
              if r["framework"] == "pyspark"]
    assert ranked == sorted(ranked)


def test_load_run_metrics_prefers_combined(spark, tmp_path):
    import json
    from kassa.sources.metrics import load_run_metrics
    one = {"framework": "pyspark", "scale_label": "10K", "time_total_s": 1.5, "raw_rows": 10}
    (tmp_path / "pyspark_metrics_10K.json").write_text(json.dumps(one))
    assert load_run_metrics(spark, str(tmp_path)).count() == 1
    both = [one, dict(one, scale_label="100K", raw_rows=100)]
    (tmp_path / "combined_metrics.json").write_text(json.dumps(both))
    runs = load_run_metrics(spark, str(tmp_path))
    assert sorted(r["scale_label"] for r in runs.collect()) == ["100K", "10K"]
