"""The end-to-end job: extract -> transform -> load -> analytics.

Plan, per run:

* extract: the source is read once, and cleaned and enriched in the same pass.
  One shuffle by key keeps, for each key, the row that the dedup keeps and what
  the key's rows add to the raw profile (rows, missing cells). These partial
  counts are columns of the staged table, so they are right however often a task
  runs. The table is a Parquet table in the target store (``staging="table"``,
  removed at the end) or, for data that fits the cluster's memory, a
  ``MEMORY_AND_DISK`` cache (``staging="cache"``). The profiles before and after
  are sums over it;
* transform: the exact quantiles, from one column of the staged rows;
* load: the flagged table is written once as Parquet;
* analytics read the written Parquet back (a lineage cut on the shared store):
  the groups of all sets, which every KPI family is read from.
"""

from __future__ import annotations

import time
import traceback
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from decimal import ROUND_HALF_UP, Decimal

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.config import DEFAULT, MEDIAN_QUANTILE, NULL_RATE_DIGITS, RATE_DIGITS, CleanConfig
from kassa.functions import is_missing
from kassa.operators.groups import report_rows, stored_groups
from kassa.operators.normalize import prepare
from kassa.operators.kpis import kpi_tables
from kassa.operators.quality import judged_rows
from kassa.operators.report import kpi_report
from kassa.operators.quantile import quantiles
from kassa.plans.stages import Thresholds, flag
from kassa.schema import CLEAN_COLUMNS, RAW_COLUMNS, RUN_METRICS_SCHEMA
from kassa.session import delete_path
from kassa.sinks.files import append_run_metrics, write_parquet, write_report, write_rows
from kassa.sources.parquet import read_clean


@dataclass
class RunResult:
    metrics: dict
    clean_path: str
    report_path: str
    thresholds: Thresholds | None = None
    report: DataFrame | None = field(default=None, repr=False)


def profiled_rows(prepared: DataFrame, cfg: CleanConfig, raw_columns) -> DataFrame:
    """One row a key: the enriched row where the rules keep it (``_kept``), and
    what the key adds to the profiles: ``_rows`` and ``_nulls`` (missing cells)
    before, ``_left`` (missing cells) after."""
    rows = judged_rows(prepared, cfg, raw_columns)
    columns = [c for c in CLEAN_COLUMNS if c != "is_high_value"]        # the flag is never missing
    types = {f.name: f.dataType for f in rows.schema.fields}
    left = sum((is_missing(c, types[c]).cast("bigint") for c in columns), F.lit(0))
    return rows.select("_rows", "_nulls", "_kept", F.when(F.col("_kept"), left).alias("_left"),
                       *[F.when(F.col("_kept"), F.col(c)).alias(c) for c in columns])


def profiles(staged: DataFrame) -> tuple[dict, dict]:
    """Rows and missing cells before and after, from the staged partial counts."""
    zero = F.lit(0).cast("long")
    row = staged.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("_rows", "_nulls", "_left")],
                     F.count_if("_kept").alias("kept")).first()
    return {"rows": row["_rows"], "nulls": row["_nulls"]}, {"rows": row["kept"], "nulls": row["_left"]}


def _pct(part: int, whole: int, digits: int) -> float:
    if whole <= 0:
        return 0.0
    q = Decimal(part) * 100 / Decimal(whole)
    return float(q.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def quality_dict(before: dict, after: dict, n_before: int, n_after: int) -> dict:
    rb, ra = before["rows"], after["rows"]
    return {
        "rows_before": rb,
        "rows_after": ra,
        "rows_dropped": rb - ra,
        "drop_pct": _pct(rb - ra, max(rb, 1), RATE_DIGITS),
        "null_rate_before": _pct(before["nulls"], rb * n_before, NULL_RATE_DIGITS),
        "null_rate_after": _pct(after["nulls"], ra * n_after, NULL_RATE_DIGITS),
    }


def run_pipeline(spark: SparkSession, raw: DataFrame, target: str, label: str,
                 cfg: CleanConfig = DEFAULT, framework: str = "kassa",
                 partition_by: tuple[str, ...] = (), metrics_path: str | None = None,
                 kpi_tables_path: str | None = None, staging: str = "table",
                 document: bool = False, raise_errors: bool = True) -> RunResult:
    """Run the four stages on ``raw`` and write everything under ``target``:
    ``{target}/clean`` (Parquet) and ``{target}/kpi_report``, the report as rows
    (section, position, key, metric, value) or, with ``document``, as one JSON
    document whose arrays hold a section's groups (for columns of few values).
    The metrics row is appended to ``metrics_path`` when given; with
    ``kpi_tables_path`` every KPI family is also written as its own Parquet
    table.

    ``staging`` picks how the enriched table is materialised between the
    quantile passes and the final write: ``"table"`` (written once under
    ``{target}/_staged``, read back and deleted at the end) or ``"cache"``
    (``MEMORY_AND_DISK``), for data that the cluster's memory holds.

    Errors are recorded in the metrics with status ERROR (or FAILED (OOM)),
    then re-raised unless ``raise_errors=False``."""
    if staging not in ("cache", "table"):
        raise ValueError("staging is 'cache' or 'table'")
    clean_path, report_path = f"{target}/clean", f"{target}/kpi_report"
    staged_path = f"{target}/_staged"
    t_all = time.perf_counter()
    metrics: dict = {"run_id": uuid.uuid4().hex, "framework": framework, "scale_label": label,
                     "cores_used": spark.sparkContext.defaultParallelism}
    cached = None
    try:
        # 1. extract: the one pass of the source; the profiles read what it left.
        t0 = time.perf_counter()
        raw_cols = [c for c in RAW_COLUMNS if c in raw.columns]
        judged = profiled_rows(prepare(raw, cfg), cfg, raw_cols)
        if staging == "table":
            write_parquet(judged, staged_path, compression="zstd")
            staged = read_clean(spark, staged_path, judged.schema)
        else:
            staged = cached = judged.persist(StorageLevel.MEMORY_AND_DISK)
        before, after = profiles(staged)
        t_extract = time.perf_counter() - t0

        # 2. transform: the clean rows and their exact quantiles.
        t0 = time.perf_counter()
        rows = staged.where("_kept").drop("_rows", "_nulls", "_kept", "_left")
        q = quantiles(rows, "net_revenue", [cfg.high_value_quantile, MEDIAN_QUANTILE],
                      cfg.quantile_error, cache=False)
        th = Thresholds(q[cfg.high_value_quantile], q[MEDIAN_QUANTILE])
        t_transform = time.perf_counter() - t0

        # 3. load: flag and write.
        t0 = time.perf_counter()
        final = flag(rows, th)
        write_parquet(final, clean_path, partition_by=partition_by)
        if cached is not None:
            cached = cached.unpersist() and None
        t_load = time.perf_counter() - t0

        # 4. analytics: from the written table.
        t0 = time.perf_counter()
        clean_back = read_clean(spark, clean_path, final.schema)
        if document:
            report = kpi_report(clean_back, th.median, cfg)
            write_report(report, report_path)
            written = spark.read.schema(report.schema).json(report_path)
            first = written.first()
            scalars = {f.name: float(first[f.name]) for f in report.schema.fields
                       if isinstance(f.dataType, T.NumericType)}
        else:
            lines = report_rows(stored_groups(clean_back, cfg), cfg, th.median if th.median is not None else 0)
            write_rows(lines, report_path)
            written = spark.read.schema(lines.schema).json(report_path)
            scalars = {r["metric"]: r["value"] for r in written.where("section = 'overall'").collect()}
        if kpi_tables_path:
            write_kpi_tables(clean_back, th.median, kpi_tables_path, cfg)
        t_analytics = time.perf_counter() - t0

        metrics.update({
            "status": "SUCCESS", "error_msg": None,
            "raw_rows": before["rows"], "clean_rows": after["rows"],
            "time_extract_s": round(t_extract, 4), "time_transform_s": round(t_transform, 4),
            "time_load_s": round(t_load, 4), "time_analytics_s": round(t_analytics, 4),
            "time_total_s": round(time.perf_counter() - t_all, 4),
            "memory_peak_mb": None, "kpis": scalars,
            "quality": quality_dict(before, after, len(raw_cols), len(CLEAN_COLUMNS)),
        })
        result = RunResult(metrics, clean_path, report_path, th, written)
    except Exception as exc:
        text = f"{type(exc).__name__}: {exc}"
        status = "FAILED (OOM)" if "OutOfMemoryError" in text or isinstance(exc, MemoryError) \
            else "ERROR"
        metrics.update({"status": status, "error_msg": text, "time_total_s": None})
        result = RunResult(metrics, clean_path, report_path)
        if raise_errors:
            raise
        traceback.print_exc()
    finally:
        if cached is not None:
            cached.unpersist()
        if staging == "table":
            delete_path(spark, staged_path)
        metrics["finished_at"] = datetime.now(timezone.utc)
        if metrics_path:
            append_run_metrics(metrics_frame(spark, [metrics]), metrics_path)
    return result


def write_kpi_tables(clean: DataFrame, median, path: str, cfg: CleanConfig = DEFAULT) -> None:
    """Each KPI family as its own (distributed) Parquet table under ``path``."""
    for name, table in kpi_tables(clean, median, cfg).items():
        write_parquet(table, f"{path.rstrip('/')}/{name}")


def metrics_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Run-metrics rows as a DataFrame with the declared schema."""
    names = [f.name for f in RUN_METRICS_SCHEMA.fields]
    clean_rows = []
    for r in rows:
        q = r.get("quality")
        row = {n: r.get(n) for n in names}
        row["quality"] = tuple(q.get(f) for f in
                               ("rows_before", "rows_after", "rows_dropped", "drop_pct",
                                "null_rate_before", "null_rate_after")) if q else None
        clean_rows.append(tuple(row[n] for n in names))
    return spark.createDataFrame(clean_rows, RUN_METRICS_SCHEMA)
