"""Cleaning rules. Stage order is part of the meaning: dedup runs before the
null drop, so a transaction whose first copy lacks a critical value is lost
even when a later copy is complete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.config import DEFAULT, PRICE_LIMIT, CleanConfig
from kassa.functions import clip
from kassa.operators.dedup import dedup_by_key


def drop_critical_nulls(df: DataFrame, critical: Sequence[str] = DEFAULT.critical) -> DataFrame:
    """Drop rows with a null (or NaN, for floating columns) in any critical column."""
    return df.dropna(how="any", subset=list(critical))


def fill_defaults(df: DataFrame, fills=DEFAULT.fills) -> DataFrame:
    """Constants into nulls of non-critical columns (NaN too, for doubles)."""
    return df.fillna(dict(fills))


def positive_filter(df: DataFrame, price: str = DEFAULT.price,
                    quantity: str = DEFAULT.quantity) -> DataFrame:
    """Keep positive prices that the price type holds and positive quantities.

    ``price < limit`` also rejects infinity and NaN, which Spark orders above it.
    """
    p, q = F.col(price), F.col(quantity)
    return df.where((p > 0) & (p < F.lit(PRICE_LIMIT)) & (q > 0))


def clip_discount(df: DataFrame, discount: str = DEFAULT.discount,
                  low: float = 0.0, high: float = 1.0) -> DataFrame:
    return df.withColumn(discount, clip(discount, low, high))


def dedup(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    return dedup_by_key(df, cfg.key, cfg.order_by, cfg.tie_breakers, cfg.drop_after_dedup)


def clean(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    """dedup by key -> critical nulls -> fills -> range filter -> discount clip.

    The exact-row dedup is implied by the keyed one (identical rows share a
    key and tie on every column), so it costs no extra shuffle here.

    When the key is itself critical, rows with a null key are removed before
    the dedup shuffle: their group's survivor would be dropped by the null rule
    anyway, so the result is the same and a hot null key never reaches the
    exchange.
    """
    if cfg.key in cfg.critical:
        df = df.where(F.col(cfg.key).isNotNull())
    out = dedup(df, cfg)
    out = drop_critical_nulls(out, cfg.critical)
    out = fill_defaults(out, cfg.fills)
    out = positive_filter(out, cfg.price, cfg.quantity)
    return clip_discount(out, cfg.discount, *cfg.discount_range)
