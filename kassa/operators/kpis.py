"""KPI tables over the clean table. Every function is lazy and returns a
DataFrame; nothing is collected. Sums are over exact decimals, rounded HALF_UP
and reported as double, so results do not depend on partitioning or row order.

Aggregations are ``HashAggregate`` partial + final: a hot group key is
combined map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kassa.config import (AVG_DISCOUNT_DIGITS, CANCELLED_STATUS, DEFAULT, MONEY_DIGITS,
                          MONEY_TYPE, RATE_DIGITS, REFUNDED_STATUS, CleanConfig)
from kassa.functions import percent, round_money


def _money_sum(col: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0).cast(MONEY_TYPE))


def _keys(df: DataFrame, keys: list[str], cfg: CleanConfig) -> DataFrame:
    if cfg.drop_null_keys:
        return df.dropna(how="any", subset=keys)
    return df


def overall_aggregates(cfg: CleanConfig = DEFAULT) -> list:
    """Scalar KPIs that share one aggregate pass."""
    n = F.count(F.lit(1))
    status = F.col(cfg.status)
    return [
        n.alias("total_transactions"),
        round_money(_money_sum("gross_revenue"), MONEY_DIGITS).alias("total_gross_revenue"),
        round_money(_money_sum("net_revenue"), MONEY_DIGITS).alias("total_net_revenue"),
        round_money(_money_sum("discount_amt"), MONEY_DIGITS).alias("total_discount_amt"),
        round_money(F.coalesce(F.avg("net_revenue"), F.lit(0)), MONEY_DIGITS).alias("avg_order_value"),
        percent(F.coalesce(F.sum("is_high_value"), F.lit(0)), n, RATE_DIGITS).alias("high_value_txn_pct"),
        percent(F.count_if(status == CANCELLED_STATUS), n, RATE_DIGITS).alias("cancellation_rate"),
        percent(F.count_if(status == REFUNDED_STATUS), n, RATE_DIGITS).alias("refund_rate"),
    ]


def overall(df: DataFrame, median=None, cfg: CleanConfig = DEFAULT) -> DataFrame:
    """All scalar KPIs in one row; ``median`` is the exact median net revenue.
    The distinct counts have an aggregate of their own (two pruned columns), so
    the money sums are not expanded once per distinct column; both sides are one
    row."""
    med = F.lit(median if median is not None else 0).cast(MONEY_TYPE)
    totals = df.agg(*overall_aggregates(cfg)).crossJoin(distinct_counts(df, cfg))
    return totals.select(
        "total_transactions", "total_gross_revenue", "total_net_revenue", "total_discount_amt",
        "avg_order_value", "unique_customers", "unique_products", "high_value_txn_pct",
        "cancellation_rate", "refund_rate", round_money(med, MONEY_DIGITS).alias("median_order_value"))


def distinct_counts(df: DataFrame, cfg: CleanConfig = DEFAULT,
                    approx_error: float | None = None) -> DataFrame:
    """Exact distinct customers and products (nulls excluded); with
    ``approx_error`` a HyperLogLog++ estimate of that relative error instead
    (fixed memory per task, no ``Expand``)."""
    if approx_error is not None:
        return df.agg(
            F.approx_count_distinct(cfg.customer, approx_error).alias("unique_customers"),
            F.approx_count_distinct(cfg.product, approx_error).alias("unique_products"))
    return df.agg(F.count_distinct(cfg.customer).alias("unique_customers"),
                  F.count_distinct(cfg.product).alias("unique_products"))


def status_counts(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    return (_keys(df, [cfg.status], cfg).groupBy(cfg.status)
            .agg(F.count(F.lit(1)).alias("transactions")))


def status_rates(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    n = F.count(F.lit(1))
    status = F.col(cfg.status)
    return df.agg(
        percent(F.count_if(status == CANCELLED_STATUS), n, RATE_DIGITS).alias("cancellation_rate"),
        percent(F.count_if(status == REFUNDED_STATUS), n, RATE_DIGITS).alias("refund_rate"))


def category_revenue(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    """Per category: transactions, net revenue, mean discount (4 dp); by net desc."""
    return (_keys(df, [cfg.category], cfg).groupBy(cfg.category)
            .agg(F.count(F.lit(1)).alias("transactions"),
                 F.sum("net_revenue").alias("_net"),
                 F.avg(F.col(cfg.discount).cast(MONEY_TYPE)).alias("_disc"))
            .orderBy(F.desc("_net"), F.asc_nulls_first(cfg.category))
            .select(cfg.category, "transactions",
                    round_money("_net", MONEY_DIGITS).alias("net_revenue"),
                    round_money("_disc", AVG_DISCOUNT_DIGITS).alias("avg_discount")))


def monthly_trend(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    return (_keys(df, ["year", "month"], cfg).groupBy("year", "month")
            .agg(round_money(F.sum("net_revenue"), MONEY_DIGITS).alias("net_revenue"))
            .orderBy("year", "month"))


def payment_method_revenue(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    """Net revenue per payment method; a null method is its own group unless
    ``cfg.drop_null_keys``."""
    return (_keys(df, [cfg.payment], cfg).groupBy(cfg.payment)
            .agg(F.sum("net_revenue").alias("_net"))
            .orderBy(F.desc("_net"), F.asc_nulls_first(cfg.payment))
            .select(cfg.payment, round_money("_net", MONEY_DIGITS).alias("net_revenue")))


def region_performance(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    return (_keys(df, [cfg.region], cfg).groupBy(cfg.region)
            .agg(F.count(F.lit(1)).alias("transactions"), F.sum("net_revenue").alias("_net"))
            .orderBy(F.desc("_net"), F.asc_nulls_first(cfg.region))
            .select(cfg.region, "transactions",
                    round_money("_net", MONEY_DIGITS).alias("net_revenue")))


def band_dimension(spark: SparkSession, cfg: CleanConfig = DEFAULT) -> DataFrame:
    """The configured bands as a table (one row per label, fixed by config)."""
    rows = [(label, i + 1) for i, label in enumerate(cfg.band_labels)]
    return spark.createDataFrame(rows, "revenue_band string, band_rank int")


def revenue_band_dist(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    """Share of each band in percent (2 dp). Empty bands report 0.0; rows with
    no band stay out of the denominator."""
    counts = df.groupBy("revenue_band").agg(F.count(F.lit(1)).alias("transactions"))
    # Band values come from the configured labels, so `counts` has at most
    # len(band_labels) + 1 rows (bounded by configuration, not by data): it is
    # broadcast, and the total is a window over that bounded table. The left
    # join from the configured bands drops the group of rows without a band
    # (filtering before the aggregate would make Catalyst evaluate the band
    # expression twice).
    dim = band_dimension(df.sparkSession, cfg)
    out = (dim.join(F.broadcast(counts), "revenue_band", "left")
              .withColumn("transactions", F.coalesce("transactions", F.lit(0)).cast("long")))
    total = F.sum("transactions").over(Window.partitionBy())
    return (out.select("revenue_band", "band_rank", "transactions",
                       percent(F.col("transactions"), total, RATE_DIGITS).alias("pct"))
               .orderBy("band_rank"))


def top_customers(df: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    """The k customers with the largest net revenue; ties go to the lower id.
    Planned as ``TakeOrderedAndProject``: each task keeps only its k best."""
    return (_keys(df, [cfg.customer], cfg).groupBy(cfg.customer)
            .agg(F.sum("net_revenue").alias("_net"))
            .orderBy(F.desc("_net"), F.asc_nulls_first(cfg.customer))
            .limit(cfg.top_customers)
            .select(cfg.customer, round_money("_net", MONEY_DIGITS).alias("net_revenue")))


def kpi_tables(df: DataFrame, median=None, cfg: CleanConfig = DEFAULT) -> dict[str, DataFrame]:
    """Every KPI family as a lazy DataFrame, keyed by report field."""
    return {
        "overall": overall(df, median, cfg),
        "status_counts": status_counts(df, cfg),
        "category_revenue": category_revenue(df, cfg),
        "monthly_trend": monthly_trend(df, cfg),
        "payment_method_revenue": payment_method_revenue(df, cfg),
        "region_performance": region_performance(df, cfg),
        "revenue_band_dist": revenue_band_dist(df, cfg),
        "top_customers": top_customers(df, cfg),
    }
