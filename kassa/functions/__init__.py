"""Column expressions built only from ``pyspark.sql.functions`` (JVM side)."""

from kassa.functions.columns import (
    banded,
    clip,
    day_of_week,
    is_missing,
    na_to_null,
    percent,
    round_money,
    tolerant_timestamp,
)
from kassa.functions.packing import dealt

__all__ = [
    "banded", "clip", "day_of_week", "dealt", "is_missing", "na_to_null",
    "percent", "round_money", "tolerant_timestamp",
]
