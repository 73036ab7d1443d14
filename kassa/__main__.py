"""Command line: ``spark-submit -m kassa ...`` or ``python -m kassa ...``.

  run        CSV transactions -> clean Parquet + KPI report (+ run metrics)
  generate   synthetic transactions for named scales, as CSV
  benchmark  generate and run each named scale in one session, then compare
  compare    summary / speed-up / throughput / stage tables of a run-metrics folder
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from kassa.config import SCALES
from kassa.session import shared_dir


def _session(app: str) -> SparkSession:
    spark = SparkSession.builder.appName(app).getOrCreate()
    shared_dir(spark)
    return spark


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kassa")
    sub = parser.add_subparsers(dest="cmd", required=True)

    run = sub.add_parser("run", help="clean, load and analyse one CSV dataset")
    run.add_argument("input", help="CSV file or folder")
    run.add_argument("target", help="output folder (clean/ and kpi_report/)")
    run.add_argument("--label", default="run")
    run.add_argument("--metrics", help="run-metrics folder to append to")
    run.add_argument("--kpi-tables", action="store_true", help="also one Parquet table per KPI")
    run.add_argument("--approx-quantiles", type=float, metavar="ERR",
                     help="approximate p90/median with this rank error")
    run.add_argument("--partition-by", default="",
                     help="comma-separated sink partition columns, e.g. year,month")
    run.add_argument("--staging", choices=("cache", "table"), default="table",
                     help="materialise the enriched table as a table or in memory")
    run.add_argument("--document", action="store_true",
                     help="the KPI report as one JSON document instead of rows")
    run.add_argument("--multi-line", action="store_true", help="line ends inside quoted CSV fields")

    gen = sub.add_parser("generate", help="write synthetic transactions as CSV")
    gen.add_argument("out_dir")
    gen.add_argument("scales", nargs="*", default=list(SCALES), choices=list(SCALES))
    gen.add_argument("--seed", type=int, default=42)

    bench = sub.add_parser("benchmark", help="generate + run each scale, then compare")
    bench.add_argument("work_dir", help="data/, out/ and metrics/ go here")
    bench.add_argument("scales", nargs="*", default=list(SCALES), choices=list(SCALES))
    bench.add_argument("--seed", type=int, default=42)
    bench.add_argument("--baseline-metrics", help="run-metrics folder of the framework to compare with")
    bench.add_argument("--baseline", default="pandas")

    cmp_ = sub.add_parser("compare", help="tables over a run-metrics folder")
    cmp_.add_argument("metrics")
    cmp_.add_argument("--baseline", default="pandas")
    cmp_.add_argument("--candidate", default="pyspark")

    args = parser.parse_args(argv)
    if args.cmd == "run":
        from dataclasses import replace

        from kassa.config import DEFAULT
        from kassa.plans.run import run_pipeline
        from kassa.sources.csv import read_transactions_csv
        spark = _session(f"kassa-run-{args.label}")
        cfg = replace(DEFAULT, quantile_error=args.approx_quantiles)
        result = run_pipeline(spark, read_transactions_csv(spark, args.input,
                                                           multi_line=args.multi_line), args.target,
                              args.label, cfg, metrics_path=args.metrics,
                              kpi_tables_path=f"{args.target}/kpis" if args.kpi_tables else None,
                              partition_by=tuple(c for c in args.partition_by.split(",") if c),
                              staging=args.staging, document=args.document)
        print(json.dumps(result.metrics, default=str))
    elif args.cmd == "generate":
        from kassa.sources.generate import generate_dataset
        spark = _session("kassa-generate")
        for scale in args.scales:
            print(generate_dataset(spark, scale, args.out_dir, seed=args.seed))
    elif args.cmd == "benchmark":
        from kassa.plans.run import run_pipeline
        from kassa.sources.csv import read_transactions_csv
        from kassa.sinks.files import write_combined_metrics
        from kassa.sources.generate import generate_dataset
        from kassa.sources.metrics import load_run_metrics, read_run_metrics
        spark = _session("kassa-benchmark")
        work = args.work_dir.rstrip("/")
        for scale in args.scales:  # smaller scales first, in one session
            label = SCALES[scale][1]
            path = generate_dataset(spark, scale, f"{work}/data", seed=args.seed)
            result = run_pipeline(spark, read_transactions_csv(spark, path),
                                  f"{work}/out/{label}", label, framework="pyspark",
                                  metrics_path=f"{work}/metrics/runs", raise_errors=False)
            print(json.dumps(result.metrics, default=str))
        runs = read_run_metrics(spark, f"{work}/metrics/runs", "part-*.json", multiline=False)
        write_combined_metrics(runs, f"{work}/metrics/combined_metrics.json")
        if args.baseline_metrics:
            runs = runs.unionByName(load_run_metrics(spark, args.baseline_metrics))
        _tables(runs, args.baseline if args.baseline_metrics else None, "pyspark")
    else:
        spark = _session("kassa-compare")
        from kassa.sources.metrics import load_run_metrics
        _tables(load_run_metrics(spark, args.metrics), args.baseline, args.candidate)
    return 0


def _tables(runs, baseline: str | None, candidate: str) -> None:
    """The comparison tables; the speed-up only where there is a baseline."""
    from kassa.operators import compare
    compare.summary_table(runs).show(truncate=False)
    if baseline:
        compare.speedup(runs, baseline, candidate).show(truncate=False)
    compare.throughput(runs).show(truncate=False)
    compare.stage_breakdown(runs).show(truncate=False)


if __name__ == "__main__":
    sys.exit(main())
