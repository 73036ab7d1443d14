"""Input normalisation: missing-value tokens and the tolerant timestamp parse.

Both run before deduplication, so the key dedup orders by the parsed time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.config import DEFAULT, CleanConfig
from kassa.functions import na_to_null, tolerant_timestamp


def normalize_na_tokens(df: DataFrame, tokens: Sequence[str] = DEFAULT.na_tokens,
                        columns: Sequence[str] | None = None) -> DataFrame:
    """Text cells equal to a missing-value token become null (string columns)."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not columns:
        return df
    return df.withColumns({c: na_to_null(c, tokens) for c in columns})


def parse_timestamps(df: DataFrame, column: str = DEFAULT.timestamp,
                     fmt: str = DEFAULT.timestamp_format) -> DataFrame:
    """Text timestamps are parsed tolerantly; typed ones become ``timestamp_ntz``."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        return df.withColumn(column, tolerant_timestamp(column, fmt))
    if isinstance(dtype, T.TimestampNTZType):
        return df
    return df.withColumn(column, F.col(column).cast(T.TimestampNTZType()))


def prepare(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    """NA tokens, then timestamp parse: the raw table the quality report profiles."""
    return parse_timestamps(normalize_na_tokens(df, cfg.na_tokens), cfg.timestamp,
                            cfg.timestamp_format)
