"""The KPI report as a document: every family in one row (its arrays hold a
section's groups, so it is for the low-cardinality columns it is made of). The
report as rows is ``operators.groups.report_rows``.

The document is one Spark SQL statement over the clean table:

* ``totals``: one global aggregate (counts, money sums, status and
  high-value counts);
* ``groups``: one ``GROUPING SETS`` aggregate over the low-cardinality
  dimensions (category, month, payment method, region, band): one scan, one
  ``Expand``, partial aggregation map-side, one small shuffle; its groups are
  packed into ordered arrays, one element per group, which is the content of
  the report itself;
* ``customers``: net revenue per customer, cut to the top k by
  ``TakeOrderedAndProject`` (each task keeps only its k best);
* distinct customers and products: two ``count(DISTINCT)`` in one aggregate
  (Spark expands each row once per distinct column and de-duplicates
  map-side before the shuffle).

Every branch ends in exactly one row, so the cross joins are one-row joins
(their broadcast sides are one row by construction).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame

from kassa.config import (AVG_DISCOUNT_DIGITS, CANCELLED_STATUS, DEFAULT, MONEY_DIGITS,
                          MONEY_TYPE, RATE_DIGITS, REFUNDED_STATUS, CleanConfig)
from kassa.functions.columns import sql_name, sql_string


def percent_sql(part: str, whole: str, digits: int = RATE_DIGITS) -> str:
    """``part / max(whole, 1) * 100``, HALF_UP on exact decimals (as ``percent``)."""
    return (f"CAST(round(CAST({part} AS DECIMAL(20,0)) * 100 / "
            f"CAST(greatest({whole}, 1) AS DECIMAL(20,0)), {digits}) AS DOUBLE)")


def money_sql(expr: str, digits: int = MONEY_DIGITS) -> str:
    return f"CAST(round({expr}, {digits}) AS DOUBLE)"


def _grouping_ids(keys: list[str], sets: dict[str, list[str]]) -> dict[str, int]:
    """grouping_id(keys...): a bit per key not in the set, first key highest."""
    width = len(keys)
    return {name: sum(1 << (width - 1 - i) for i, k in enumerate(keys) if k not in cols)
            for name, cols in sets.items()}


def report_sql(cfg: CleanConfig = DEFAULT, median: Decimal | float | None = None) -> str:
    cat, pay, reg = sql_name(cfg.category), sql_name(cfg.payment), sql_name(cfg.region)
    cust, prod, st = sql_name(cfg.customer), sql_name(cfg.product), sql_name(cfg.status)
    disc = sql_name(cfg.discount)
    keys = [cat, "year", "month", pay, reg, "revenue_band"]
    sets = {"category": [cat], "month": ["year", "month"], "payment": [pay],
            "region": [reg], "band": ["revenue_band"]}
    gid = _grouping_ids(keys, sets)
    med = f"CAST('{Decimal(median if median is not None else 0)}' AS DECIMAL(38,12))"
    labels = ", ".join(sql_string(b) for b in cfg.band_labels)

    def packed(name: str, order: list[str], fields: list[tuple[str, str]]) -> str:
        keyed = ", ".join([f"{o} AS _k{i}" for i, o in enumerate(order)]
                          + [f"{expr} AS {sql_name(alias)}" for alias, expr in fields])
        rebuilt = ", ".join(f"{sql_string(alias)}, s.{sql_name(alias)}" for alias, _ in fields)
        return (f"transform(sort_array(collect_list(struct({keyed})) "
                f"FILTER (WHERE gid = {gid[name]})), s -> named_struct({rebuilt}))")

    net2 = money_sql("net")
    category = packed("category", ["-net", cat],
                      [(cfg.category, cat), ("transactions", "n"), ("net_revenue", net2),
                       ("avg_discount", money_sql("disc_sum / n", AVG_DISCOUNT_DIGITS))])
    monthly = packed("month", ["year", "month"],
                     [("year", "year"), ("month", "month"), ("net_revenue", net2)])
    payment = packed("payment", ["-net", pay], [(cfg.payment, pay), ("net_revenue", net2)])
    region = packed("region", ["-net", reg],
                    [(cfg.region, reg), ("transactions", "n"), ("net_revenue", net2)])
    band = f"gid = {gid['band']} AND revenue_band IS NOT NULL"
    return f"""
WITH totals AS (
  SELECT count(*) AS n, sum(gross_revenue) AS gross, sum(net_revenue) AS net,
         sum(discount_amt) AS disc, sum(is_high_value) AS high,
         count_if({st} = {sql_string(CANCELLED_STATUS)}) AS cancelled,
         count_if({st} = {sql_string(REFUNDED_STATUS)}) AS refunded
  FROM {{clean}}),
groups AS (
  SELECT {", ".join(keys)}, count(*) AS n, sum(net_revenue) AS net,
         sum(CAST({disc} AS {MONEY_TYPE})) AS disc_sum,
         grouping_id({", ".join(keys)}) AS gid
  FROM {{clean}}
  GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(c) + ")" for c in sets.values())})),
packed AS (
  SELECT {category} AS category_revenue,
         {monthly} AS monthly_trend,
         {payment} AS payment_method_revenue,
         {region} AS region_performance,
         map_from_entries(collect_list(struct(revenue_band, n)) FILTER (WHERE {band}))
           AS band_n,
         coalesce(sum(n) FILTER (WHERE {band}), 0) AS band_total
  FROM groups),
customers AS (
  SELECT {cust}, sum(net_revenue) AS net FROM {{clean}} GROUP BY {cust}),
top AS (
  SELECT transform(sort_array(collect_list(struct(-net AS _k0, {cust} AS _k1, {cust},
                                                  {net2} AS net_revenue))),
                   s -> named_struct({sql_string(cfg.customer)}, s.{cust},
                                     'net_revenue', s.net_revenue)) AS top_10_customers
  FROM (SELECT * FROM customers ORDER BY net DESC, {cust} ASC NULLS FIRST
        LIMIT {int(cfg.top_customers)}) t)
SELECT
  t.n AS total_transactions,
  {money_sql("coalesce(t.gross, 0)")} AS total_gross_revenue,
  {money_sql("coalesce(t.net, 0)")} AS total_net_revenue,
  {money_sql("coalesce(t.disc, 0)")} AS total_discount_amt,
  {money_sql("coalesce(t.net / greatest(t.n, 1), 0)")} AS avg_order_value,
  {money_sql(med)} AS median_order_value,
  d.unique_customers, d.unique_products,
  {percent_sql("coalesce(t.high, 0)", "t.n")} AS high_value_txn_pct,
  {percent_sql("t.cancelled", "t.n")} AS cancellation_rate,
  {percent_sql("t.refunded", "t.n")} AS refund_rate,
  p.category_revenue, p.monthly_trend, p.payment_method_revenue, p.region_performance,
  transform(array({labels}), l -> named_struct('revenue_band', l,
    'pct', {percent_sql("coalesce(element_at(p.band_n, l), 0)", "p.band_total")}))
    AS revenue_band_dist,
  k.top_10_customers
FROM totals t
CROSS JOIN packed p
CROSS JOIN (SELECT count(DISTINCT {cust}) AS unique_customers,
                   count(DISTINCT {prod}) AS unique_products FROM {{clean}}) d
CROSS JOIN top k"""


def kpi_report(clean: DataFrame, median=None, cfg: CleanConfig = DEFAULT) -> DataFrame:
    """Every KPI family of the clean table as one row (``median`` is the exact
    median net revenue, computed with the high-value threshold)."""
    return clean.sparkSession.sql(report_sql(cfg, median), clean=clean)
