"""Run comparison: tables over the run-metrics history (one row per run).

Charts, Markdown and HTML of the original are presentation only; these are
the tables they were drawn from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUCCESS = "SUCCESS"
STAGES = ("extract", "transform", "load", "analytics")


def _ok():
    return F.coalesce(F.col("status"), F.lit(SUCCESS)) == SUCCESS


def _if_ok(col: str):
    return F.when(_ok(), F.col(col))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of every (framework, scale): the one that finished last;
    runs without a time come before those with one, ties go to the higher id."""
    order = Window.partitionBy("framework", "scale_label").orderBy(
        F.desc_nulls_last("finished_at"), F.desc_nulls_last("run_id"))
    return runs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def summary_table(runs: DataFrame) -> DataFrame:
    """One row per run: counts, stage times, memory and quality. A failed run
    keeps framework, scale, cores, memory and its status; the rest is null."""
    return runs.select(
        "framework", "scale_label",
        F.coalesce("status", F.lit(SUCCESS)).alias("status"),
        _if_ok("raw_rows").alias("raw_rows"),
        _if_ok("clean_rows").alias("clean_rows"),
        "cores_used",
        *[_if_ok(f"time_{s}_s").alias(f"time_{s}_s") for s in STAGES],
        _if_ok("time_total_s").alias("time_total_s"),
        "memory_peak_mb",
        _if_ok("quality.null_rate_before").alias("null_rate_before"),
        _if_ok("quality.null_rate_after").alias("null_rate_after"),
        _if_ok("quality.drop_pct").alias("drop_pct"),
    )


def align(runs: DataFrame, baseline: str = "pandas", candidate: str = "pyspark") -> DataFrame:
    """Baseline and candidate side by side on the scales both ran: the newest
    run of each, so a scale is one row however often it was run."""
    def side(fw: str, p: str) -> DataFrame:
        return latest_runs(runs.where(F.col("framework") == fw)).select(
            "scale_label",
            F.coalesce("status", F.lit(SUCCESS)).alias(f"{p}_status"),
            F.col("raw_rows").alias(f"{p}_raw_rows"),
            _if_ok("time_total_s").alias(f"{p}_total_s"),
            *[_if_ok(f"time_{s}_s").alias(f"{p}_{s}_s") for s in STAGES])
    return side(baseline, "base").join(side(candidate, "cand"), "scale_label")


def speedup(runs: DataFrame, baseline: str = "pandas", candidate: str = "pyspark") -> DataFrame:
    """baseline total / max(candidate total, 1e-6); null when either run failed.
    ``faster`` marks a speed-up above 1."""
    a = align(runs, baseline, candidate)
    # greatest() skips nulls: a failed candidate must not become 1e-6 seconds.
    su = F.when(F.col("cand_total_s").isNotNull(),
                F.col("base_total_s") / F.greatest(F.col("cand_total_s"), F.lit(1e-6)))
    return a.select(
        "scale_label", F.coalesce("base_raw_rows", "cand_raw_rows").alias("raw_rows"),
        "base_total_s", "cand_total_s", su.alias("speedup"),
        F.when(su > 1.0, "faster").when(su.isNotNull(), "slower").alias("mark"),
    ).orderBy("raw_rows")


def throughput(runs: DataFrame) -> DataFrame:
    """Thousand raw rows per second of every successful run."""
    return runs.where(_ok()).select(
        "framework", "scale_label", "raw_rows", "time_total_s",
        (F.col("raw_rows") / F.greatest(F.col("time_total_s"), F.lit(1e-6)) / 1000.0)
        .alias("k_rows_per_s"))


def stage_breakdown(runs: DataFrame, scale_label: str | None = None) -> DataFrame:
    """Long form (framework, scale_label, stage, seconds) of the four stage
    times, for one scale or, by default, the largest by raw rows (not by the
    label's text order)."""
    ok = runs.where(_ok())
    if scale_label is None:
        biggest = ok.agg(F.max("raw_rows").alias("_m"))  # a global aggregate: one row
        ok = ok.join(F.broadcast(biggest), F.col("raw_rows") == F.col("_m")).drop("_m")
    else:
        ok = ok.where(F.col("scale_label") == scale_label)
    return ok.unpivot(
        ["framework", "scale_label"],
        [f"time_{s}_s" for s in STAGES], "stage", "seconds",
    ).withColumn("stage", F.regexp_extract("stage", r"time_(\w+)_s", 1))


def quality_series(runs: DataFrame) -> DataFrame:
    """drop %, null rate before and after, per framework and scale."""
    return runs.where(_ok()).select(
        "framework", "scale_label", "raw_rows",
        F.col("quality.drop_pct").alias("drop_pct"),
        F.col("quality.null_rate_before").alias("null_rate_before"),
        F.col("quality.null_rate_after").alias("null_rate_after"),
    ).orderBy("framework", "raw_rows")


def ranked_runs(runs: DataFrame) -> DataFrame:
    """Runs ordered by total time within each framework; ``place`` counts from
    1, equal times in the order of their ids, failed runs last."""
    time, run = _if_ok("time_total_s"), F.asc_nulls_last("run_id")
    order = Window.partitionBy("framework").orderBy(F.asc_nulls_last(time), run)
    return runs.withColumn("place", F.row_number().over(order)).orderBy("framework", "place")
