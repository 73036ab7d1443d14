"""Exact-row and keyed deduplication.

Keyed dedup is ``row_number() == 1`` over the key. Catalyst plans it as a
``WindowGroupLimit`` in two phases: a partial limit runs before the shuffle,
so a hot key (even one holding a third of all rows) leaves each map task as a
single row, and the exchange carries at most one row per key per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RN = "__dedup_rn"


def exact_dedup(df: DataFrame) -> DataFrame:
    """Bag to set over all columns (hash aggregate with map-side partial dedup)."""
    return df.dropDuplicates()


def dedup_by_key(df: DataFrame, key: str, order_by: Sequence[str],
                 tie_breakers: Sequence[str] | None = None,
                 drop: Sequence[str] = ()) -> DataFrame:
    """Keep the first row of every key by ``order_by`` then ``tie_breakers``,
    all ascending with nulls first.

    ``tie_breakers=None`` uses every other column, so the survivor is fully
    determined by the data (ties remain only between identical rows).
    Null keys form one group, as in SQL.
    """
    order = list(order_by)
    if tie_breakers is None:
        tie_breakers = [c for c in df.columns if c != key and c not in order]
    order += [c for c in tie_breakers if c not in order]
    w = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (df.withColumn(_RN, F.row_number().over(w))
              .where(F.col(_RN) == 1)
              .drop(_RN, *drop))
