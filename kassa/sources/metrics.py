"""Run-metrics history source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kassa.schema import RUN_METRICS_SCHEMA
from kassa.session import path_exists


def read_run_metrics(spark: SparkSession, path: str, pattern: str = "*_metrics_*.json",
                     multiline: bool = True) -> DataFrame:
    """Run-metrics JSON documents under ``path`` (one document per file, or
    JSON lines with ``multiline=False``), read with the declared schema.
    A missing ``status`` means SUCCESS (handled by the comparison operators).
    The folders that the sink keeps a run in are looked into."""
    reader = (spark.read.schema(RUN_METRICS_SCHEMA).option("multiLine", multiline)
              .option("recursiveFileLookup", True))
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.json(path)


def load_run_metrics(spark: SparkSession, directory: str,
                     combined: str = "combined_metrics.json") -> DataFrame:
    """The run history of a metrics folder: the combined document (a JSON
    array of runs) when present, else every ``*_metrics_*.json`` document plus
    the JSON-lines files appended by ``sinks.append_run_metrics``."""
    whole = read_run_metrics(spark, directory, combined)
    if not whole.isEmpty():  # a small document: the check reads at most one run
        return whole
    folder = f"{directory.rstrip('/')}/{combined}"
    if path_exists(spark, folder):  # as written by sinks.write_combined_metrics
        return read_run_metrics(spark, folder, "part-*.json", multiline=False)
    per_run = read_run_metrics(spark, directory)                      # one document each
    appended = read_run_metrics(spark, directory, "part-*.json", multiline=False)  # our sink
    return per_run.unionByName(appended)
