"""Derived columns: revenue (exact decimals), calendar parts, revenue band and
the high-value flag."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kassa.config import DEFAULT, MONEY_TYPE, PRICE_TYPE, RATE_TYPE, CleanConfig
from kassa.functions import banded, day_of_week


def revenue_exprs(cfg: CleanConfig = DEFAULT) -> dict[str, Column]:
    """Exact amounts. The discount is taken of the whole and of the fractional
    part of the gross amount apart: both products fit 38 digits unrounded, so
    the amount is rounded once, HALF_UP at 6 places."""
    price = F.col(cfg.price).try_cast(PRICE_TYPE)
    rate = F.col(cfg.discount).try_cast(RATE_TYPE)
    gross = price * F.col(cfg.quantity).cast("decimal(10,0)")
    whole = F.floor(gross).cast("decimal(30,0)")
    part = (gross - whole).cast("decimal(6,6)")
    disc = (whole * rate).cast(MONEY_TYPE) + F.round(part * rate, 6)
    gross, disc = gross.cast(MONEY_TYPE), disc.cast(MONEY_TYPE)
    return {
        "gross_revenue": gross,
        "discount_amt": disc,
        "net_revenue": (gross - disc).cast(MONEY_TYPE),
    }


def revenue_columns(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    """gross = price*quantity, discount_amt = gross*discount, net = gross - discount_amt."""
    return df.withColumns(revenue_exprs(cfg))


def calendar_parts(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    ts = F.col(cfg.timestamp)
    return df.withColumns({
        "month": F.month(ts),
        "year": F.year(ts),
        "quarter": F.quarter(ts),
        "dow": day_of_week(ts, cfg.week_start),
    })


def revenue_band(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    return df.withColumn("revenue_band",
                         banded("net_revenue", cfg.band_edges, cfg.band_labels))


def enrich(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    """All derived columns except the flag, which needs a data-wide quantile."""
    return revenue_band(calendar_parts(revenue_columns(df, cfg), cfg), cfg)


def high_value_flag(df: DataFrame, threshold: Decimal | float | DataFrame | None,
                    column: str = "net_revenue") -> DataFrame:
    """``column > threshold`` as 0/1 (strict). No threshold (empty table) -> 0.
    A threshold can be a one-row, one-column DataFrame: it is then a scalar
    subquery of the plan, and nothing runs here."""
    if threshold is None:
        return df.withColumn("is_high_value", F.lit(0))
    if isinstance(threshold, DataFrame):
        limit = threshold.scalar()
        return df.withColumn("is_high_value", F.when(limit.isNull(), 0).otherwise((F.col(column) > limit).cast("int")))
    return df.withColumn("is_high_value",
                         (F.col(column) > F.lit(threshold)).cast("int"))
