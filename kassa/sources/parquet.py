"""Parquet sources: the written clean table and generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_clean(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The clean table as written by the load stage. Reading it back instead
    of holding it in memory gives the analytics column pruning, filter
    pushdown and a lineage that survives executor loss. A known ``schema``
    skips reading file footers to infer it."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)
