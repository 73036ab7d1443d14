"""Bag union of a table with itself ("memory stress" input)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replicate(df: DataFrame, copies: int) -> DataFrame:
    """Every row ``copies`` times.

    One scan and a ``Generate`` (explode of a literal sequence) instead of a
    union of ``copies`` scans; no join, no shuffle.
    """
    if copies < 1:
        raise ValueError("copies must be at least 1")
    if copies == 1:
        return df
    return (df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
              .drop("__copy"))
