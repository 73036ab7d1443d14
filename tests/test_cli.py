"""The command line, driven through main(argv) on the test session."""

from __future__ import annotations

import json

from kassa.__main__ import main
from kassa.session import scratch_path


def test_generate_run_compare(spark, capsys):
    work = scratch_path(spark, "cli")
    assert main(["generate", f"{work}/data", "small"]) == 0
    data = capsys.readouterr().out.strip().splitlines()[-1]
    assert main(["run", data, f"{work}/out", "--label", "10K", "--metrics", f"{work}/metrics",
                 "--kpi-tables", "--partition-by", "year,month"]) == 0
    metrics = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert metrics["status"] == "SUCCESS" and metrics["raw_rows"] == 10_000
    assert spark.read.parquet(f"{work}/out/clean").count() == metrics["clean_rows"]
    assert spark.read.parquet(f"{work}/out/kpis/top_customers").count() == 10
    assert main(["compare", f"{work}/metrics"]) == 0
    assert "10K" in capsys.readouterr().out
