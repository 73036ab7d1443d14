"""Raw byte files through Spark's own committed writer.

A file of an operator is a row of bytes. Spark's text writer puts the bytes of
a string column down unchanged and adds one line feed after each row, so a
format that ends in (or skips) one line feed can be written by the task-commit
protocol to any store that Spark reaches, and retried or speculative tasks
leave nothing behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_bytes(blobs: DataFrame, path: str, column: str = "blob",
                rows_per_file: int = 1, compression: str = "none") -> None:
    """One file of at most ``rows_per_file`` blobs after another, each blob
    followed by a line feed."""
    (blobs.select(F.col(column).cast("string").alias("value"))
     .write.option("maxRecordsPerFile", rows_per_file)
     .option("compression", compression).text(path))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of every file under ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
