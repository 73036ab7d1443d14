"""Null profile, null rate and the before/after quality report.

Each profile is a single aggregate pass; NaN in floating columns counts as a
missing cell. Both sides of the report are one-row aggregates, so the report
is a one-row x one-row cross join (a proven size bound of one row).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.config import DEFAULT, NULL_RATE_DIGITS, PRICE_LIMIT, RATE_DIGITS, CleanConfig
from kassa.functions import is_missing, percent
from kassa.operators.clean import clip_discount, fill_defaults
from kassa.operators.enrich import enrich


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``rows``, ``null_<column>`` per column, ``null_cells``, ``cells``."""
    columns = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    counts = [F.count_if(is_missing(c, types[c])).alias(f"null_{c}") for c in columns]
    prof = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    cells = sum((F.col(f"null_{c}") for c in columns), F.lit(0))
    return prof.withColumns({
        "null_cells": cells.cast("long"),
        "cells": (F.col("rows") * F.lit(len(columns))).cast("long"),
    })


def null_rate(df: DataFrame, columns: Sequence[str] | None = None,
              digits: int = NULL_RATE_DIGITS) -> DataFrame:
    """One row: ``rows`` and ``null_rate`` in percent (0.0 for an empty table)."""
    prof = null_profile(df, columns)
    return prof.select("rows", percent("null_cells", "cells", digits).alias("null_rate"))


def quality_report(before: DataFrame, after: DataFrame,
                   before_columns: Sequence[str] | None = None,
                   after_columns: Sequence[str] | None = None) -> DataFrame:
    """rows_before/after/dropped, drop_pct (2 dp), null_rate_before/after (%, 4 dp)."""
    b = null_rate(before, before_columns).select(
        F.col("rows").alias("rows_before"), F.col("null_rate").alias("null_rate_before"))
    a = null_rate(after, after_columns).select(
        F.col("rows").alias("rows_after"), F.col("null_rate").alias("null_rate_after"))
    return quality_from_counts(b.crossJoin(a))


def judged_rows(prepared: DataFrame, cfg: CleanConfig = DEFAULT,
                before_columns: Sequence[str] | None = None) -> DataFrame:
    """One enriched row per key, from one scan and one shuffle of ``prepared``.

    Each key keeps its row count (``_rows``), its missing cells (``_nulls``) and
    (the least row, combined map-side) the row that the keyed dedup keeps;
    ``_kept`` says whether the cleaning rules keep that row. What decides comes
    first in the compared row, so every cell is shuffled once, and the key only
    as the key.
    """
    before_columns = list(before_columns or prepared.columns)
    types = {f.name: f.dataType for f in prepared.schema.fields}
    ties = cfg.tie_breakers if cfg.tie_breakers is not None else tuple(
        c for c in prepared.columns if c not in (cfg.key, *cfg.order_by))
    order = list(dict.fromkeys((*cfg.order_by, *ties)))
    row = F.struct(*[F.col(c) for c in (*order, *(c for c in prepared.columns if c not in (cfg.key, *order)))])
    missing = sum((is_missing(c, types[c]).cast("bigint") for c in before_columns), F.lit(0))
    per_key = prepared.groupBy(F.col(cfg.key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(missing).alias("_nulls"),
        F.min(row).alias("_first"))
    rows = per_key.select("_rows", "_nulls", *[
        (F.col("_key") if c == cfg.key else F.col("_first")[c]).alias(c) for c in prepared.columns])
    kept = F.lit(True)
    for c in cfg.critical:
        kept = kept & ~is_missing(c, types[c])
    kept = kept & (F.col(cfg.price) > 0) & (F.col(cfg.price) < F.lit(PRICE_LIMIT)) & (F.col(cfg.quantity) > 0)
    rows = rows.withColumn("_kept", F.coalesce(kept, F.lit(False)))
    # A dropped row's price may not fit its type: it takes no part from here on.
    rows = rows.withColumn(cfg.price, F.when(F.col("_kept"), F.col(cfg.price)))
    return enrich(clip_discount(fill_defaults(rows, cfg.fills), cfg.discount, *cfg.discount_range), cfg)


def quality_one_pass(prepared: DataFrame, cfg: CleanConfig = DEFAULT,
                     before_columns: Sequence[str] | None = None,
                     after_columns: Sequence[str] | None = None) -> DataFrame:
    """The report of cleaning ``prepared`` from one scan of it."""
    before_columns = list(before_columns or prepared.columns)
    clean = judged_rows(prepared, cfg, before_columns)
    after_columns = [c for c in (after_columns or clean.columns) if c != "is_high_value"]  # never missing
    after = {f.name: f.dataType for f in clean.schema.fields}
    left = sum((is_missing(c, after[c]).cast("bigint") for c in after_columns), F.lit(0))
    n_after = len(after_columns) + 1
    sums = clean.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("_nulls"), F.lit(0)).alias("_nulls_before"),
        F.count_if("_kept").alias("rows_after"),
        F.coalesce(F.sum(F.when(F.col("_kept"), left)), F.lit(0)).alias("_nulls_after"))
    return quality_from_counts(sums.select(
        "rows_before", "rows_after",
        percent("_nulls_before", F.col("rows_before") * len(before_columns), NULL_RATE_DIGITS).alias("null_rate_before"),
        percent("_nulls_after", F.col("rows_after") * n_after, NULL_RATE_DIGITS).alias("null_rate_after")))


def quality_from_counts(df: DataFrame) -> DataFrame:
    """Finish the report from rows_before, rows_after and the two null rates."""
    dropped = F.col("rows_before") - F.col("rows_after")
    return df.select(
        "rows_before", "rows_after", dropped.alias("rows_dropped"),
        percent(dropped, F.col("rows_before"), RATE_DIGITS).alias("drop_pct"),
        "null_rate_before", "null_rate_after")
