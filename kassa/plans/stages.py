"""Stage builders over a source DataFrame: prepared -> clean -> enriched ->
flagged. All lazy: the data-wide quantiles that the flag needs are a row of the
plan (``threshold_row``), or values found before (``thresholds``, eager)."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.config import DEFAULT, MEDIAN_QUANTILE, CleanConfig
from kassa.operators.clean import clean
from kassa.operators.enrich import enrich, high_value_flag
from kassa.operators.normalize import prepare
from kassa.operators.quantile import quantiles
from kassa.operators.ranks import quantile_row, value_counts
from kassa.schema import CLEAN_COLUMNS

_MICRO = Decimal("0.000001")


@dataclass(frozen=True)
class Thresholds:
    high_value: object  # the high-value quantile of net revenue (exact or approx)
    median: object

    def rounded(self, value) -> Decimal | None:
        """A quantile as a 6-place decimal, like the money columns."""
        if value is None:
            return None
        return Decimal(value).quantize(_MICRO, rounding=ROUND_HALF_UP)


def cleaned(raw: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    return clean(prepare(raw, cfg), cfg)


def enriched(raw: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    return enrich(cleaned(raw, cfg), cfg)


def thresholds(enriched_df: DataFrame, cfg: CleanConfig = DEFAULT,
               cache: bool = True) -> Thresholds:
    """High-value quantile and median of ``net_revenue`` over the clean rows,
    computed together (exact unless ``cfg.quantile_error`` is set).
    ``cache=False`` when the input is already materialised."""
    q = quantiles(enriched_df, "net_revenue", [cfg.high_value_quantile, MEDIAN_QUANTILE],
                  cfg.quantile_error, cache=cache)
    return Thresholds(q[cfg.high_value_quantile], q[MEDIAN_QUANTILE])


def threshold_row(enriched_df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    """One row, lazy: ``high_value`` and ``median`` of ``net_revenue``,
    ``high_value_floor`` (a row is of high value when it is above the floor) and
    ``rows`` (exact unless ``cfg.quantile_error`` is set: then sketches)."""
    probs = [cfg.high_value_quantile, MEDIAN_QUANTILE]
    if cfg.quantile_error is None:
        row = quantile_row(value_counts(enriched_df, "net_revenue"), probs)
        return row.select(F.col("low_0").alias("high_value_floor"), F.col("q_0").alias("high_value"),
                          F.col("q_1").alias("median"), F.coalesce("total", F.lit(0)).alias("rows"))
    accuracy = max(1, round(1 / cfg.quantile_error))
    q = enriched_df.agg(F.percentile_approx("net_revenue", probs, accuracy).alias("q"), F.count("net_revenue").alias("rows"))
    return q.select(F.col("q")[0].alias("high_value_floor"), F.col("q")[0].alias("high_value"),
                    F.col("q")[1].alias("median"), "rows")


def flag(enriched_df: DataFrame, th: Thresholds | DataFrame) -> DataFrame:
    """The 23-column clean table; ``th`` as found before, or the lazy row."""
    limit = th.select("high_value_floor") if isinstance(th, DataFrame) else th.high_value
    return high_value_flag(enriched_df, limit).select(*CLEAN_COLUMNS)
