"""DataFrame -> DataFrame operators."""

from kassa.operators import compare, kpis, report

from kassa.operators.clean import (clean, clip_discount, dedup, drop_critical_nulls,
                                   fill_defaults, positive_filter)
from kassa.operators.dedup import dedup_by_key, exact_dedup
from kassa.operators.enrich import (calendar_parts, enrich, high_value_flag, revenue_band,
                                    revenue_columns)
from kassa.operators.normalize import normalize_na_tokens, parse_timestamps, prepare
from kassa.operators.quality import null_profile, null_rate, quality_report
from kassa.operators.quantile import (approx_quantiles, exact_quantiles, order_statistics,
                                      quantiles)
from kassa.operators.replicate import replicate

__all__ = [
    "compare", "kpis", "report",
    "approx_quantiles", "calendar_parts", "clean", "clip_discount", "dedup",
    "dedup_by_key", "drop_critical_nulls", "enrich", "exact_dedup", "exact_quantiles",
    "fill_defaults", "high_value_flag", "normalize_na_tokens", "null_profile",
    "null_rate", "order_statistics", "parse_timestamps", "positive_filter", "prepare",
    "quality_report", "quantiles", "replicate", "revenue_band", "revenue_columns",
]
