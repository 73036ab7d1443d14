"""Every KPI family from one aggregate.

``kpi_groups`` is one ``GROUPING SETS`` aggregate over the clean (or enriched)
rows: one scan, one ``Expand``, partial aggregation map-side, one shuffle. For rows
that are stored, ``stored_groups`` gives the same groups without expanding the rows:
the breakdowns of few values come from their cells (the rows grouped by these
columns together), and every set of more groups is an aggregate of its own that
scans only the columns it needs. A row is a group of one set:

* ``total``, ``status``, ``category``, ``month``, ``payment``, ``region``,
  ``band``: the low-cardinality breakdowns;
* ``customer``, ``product``: distinct counts are their numbers of groups, the
  top customers their largest;
* ``value``: net revenue by value, which holds the exact quantiles
  (``operators.ranks``) and the high-value count.

The families read those groups, never the rows again: ``overall`` and
``report_rows`` are one statement each, in which the groups are one exchange.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.config import (AVG_DISCOUNT_DIGITS, CANCELLED_STATUS, DEFAULT, MEDIAN_QUANTILE, MONEY_TYPE,
                          REFUNDED_STATUS, CleanConfig)
from kassa.functions.columns import sql_name, sql_string
from kassa.operators.ranks import LEAST_RANGES, quantile_ctes
from kassa.operators.report import money_sql, percent_sql


#: Sets that are aggregates of their own, and the sums that their families read besides ``n``.
APART = {"month": ("net", "gross", "discounts", "discount_sum", "high"), "customer": ("net",), "product": (), "value": ()}


def set_columns(cfg: CleanConfig = DEFAULT) -> dict[str, list[str]]:
    """The grouping columns of every set."""
    return {"total": [], "status": [cfg.status], "category": [cfg.category], "month": ["year", "month"],
            "payment": [cfg.payment], "region": [cfg.region], "band": ["revenue_band"],
            "customer": [cfg.customer], "product": [cfg.product], "value": ["net_revenue"]}


def kpi_groups(df: DataFrame, cfg: CleanConfig = DEFAULT, sets: tuple[str, ...] | None = None) -> DataFrame:
    """``set``, the grouping columns (null outside their set), ``n``, ``net``,
    ``gross``, ``discounts``, ``discount_sum`` and, where the rows have the
    high-value flag, ``high`` for every group of the wanted ``sets``."""
    wanted = {name: cols for name, cols in set_columns(cfg).items() if sets is None or name in sets}
    keys = list(dict.fromkeys(c for cols in wanted.values() for c in cols))
    # The grouping id has a bit a key, set where the key is outside the set.
    ids = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in cols): name
           for name, cols in wanted.items()}
    name = F.element_at(F.create_map(*[F.lit(x) for pair in ids.items() for x in pair]), F.col("_id").cast("int"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("net_revenue").alias("net"), F.sum("gross_revenue").alias("gross"),
            F.sum("discount_amt").alias("discounts"), F.sum(F.col(cfg.discount).cast(MONEY_TYPE)).alias("discount_sum")]
    if "is_high_value" in df.columns:
        sums.append(F.sum("is_high_value").alias("high"))
    grouped = df.groupingSets([[F.col(c) for c in cols] for cols in wanted.values()], *keys)
    return grouped.agg(F.grouping_id().alias("_id"), *sums).withColumn("set", name).drop("_id")


def stored_groups(df: DataFrame, cfg: CleanConfig = DEFAULT, sets: tuple[str, ...] | None = None) -> DataFrame:
    """``kpi_groups`` of rows that are cheap to read several times; null where no
    family reads that sum of the set (see ``APART``)."""
    wanted = {name: cols for name, cols in set_columns(cfg).items() if sets is None or name in sets}
    keys = list(dict.fromkeys(c for cols in wanted.values() for c in cols))
    sums = {"net": F.sum("net_revenue"), "gross": F.sum("gross_revenue"), "discounts": F.sum("discount_amt"),
            "discount_sum": F.sum(F.col(cfg.discount).cast(MONEY_TYPE))}
    types = dict.fromkeys(sums, MONEY_TYPE)
    if "is_high_value" in df.columns:
        sums["high"], types["high"] = F.sum("is_high_value"), "bigint"
    kinds = {f.name: f.dataType for f in df.schema.fields}
    n = F.count(F.lit(1)).alias("n")

    def whole(groups: DataFrame, name, of: list[str], has) -> DataFrame:
        return groups.select(
            *[F.col(k) if k in of else F.lit(None).cast(kinds[k]).alias(k) for k in keys], "n",
            *[F.col(c) if c in has else F.lit(None).cast(types[c]).alias(c) for c in sums], name.alias("set"))

    parts = []
    few = {name: cols for name, cols in wanted.items() if name not in APART}
    if few:
        cols = list(dict.fromkeys(c for of in few.values() for c in of))
        cells = df.groupBy(*cols).agg(n, *[x.alias(c) for c, x in sums.items()])
        # The grouping id has a bit a key, set where the key is outside the set.
        ids = {sum(1 << (len(cols) - 1 - i) for i, k in enumerate(cols) if k not in of): name for name, of in few.items()}
        name = F.element_at(F.create_map(*[F.lit(x) for pair in ids.items() for x in pair]), F.col("_id").cast("int"))
        rolled = cells.groupingSets([[F.col(c) for c in of] for of in few.values()], *cols).agg(
            F.grouping_id().alias("_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.sum(c).alias(c) for c in sums])
        parts.append(whole(rolled, name, cols, sums))
    for name in (x for x in wanted if x in APART):
        has = [c for c in APART[name] if c in sums]
        grouped = df.groupBy(*wanted[name]).agg(n, *[sums[c].alias(c) for c in has])
        parts.append(whole(grouped, F.lit(name), wanted[name], has))
    return reduce(DataFrame.unionByName, parts)


def _limits(rows: DataFrame, cfg: CleanConfig, median: Decimal | float | None) -> str:
    """Parts of a WITH clause from ``counts`` (net revenue by value) to
    ``limits``, the median and the rows above the high-value quantile; a known
    ``median`` spares them."""
    if median is not None:
        return f"limits AS (SELECT CAST('{Decimal(median)}' AS DECIMAL(38,9)) AS median, CAST(NULL AS BIGINT) AS high_rows)"
    ranges = max(LEAST_RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [cfg.high_value_quantile, MEDIAN_QUANTILE]
    return (f"{quantile_ctes(rows.schema['net_revenue'].dataType, probs, ranges)},\n"
            "limits AS (SELECT CAST(q_1 AS DECIMAL(38,9)) AS median, above_0 AS high_rows FROM quantile_row)")


def _values(high: str) -> dict[str, str]:
    """The scalar KPIs by name, from the row of totals ``t`` and the row ``l`` of limits."""
    return {
        "total_transactions": "t.n", "total_gross_revenue": money_sql("gross"), "total_net_revenue": money_sql("net"),
        "total_discount_amt": money_sql("discounts"),
        "avg_order_value": money_sql("coalesce(net / CAST(greatest(t.n, 1) AS DECIMAL(20,0)), 0)"),
        "unique_customers": "unique_customers", "unique_products": "unique_products",
        "high_value_txn_pct": percent_sql(f"coalesce({high}, 0)", "t.n"),
        "cancellation_rate": percent_sql("cancelled", "t.n"), "refund_rate": percent_sql("refunded", "t.n"),
        "median_order_value": money_sql("coalesce(l.median, 0)")}


def overall_of_rows(rows: DataFrame, cfg: CleanConfig = DEFAULT) -> DataFrame:
    """All scalar KPIs of enriched rows in one row and one statement. The columns
    that they need are one exchange (dealt by several columns, so that no hot
    value is one task), which the sums, the distinct counts and the exact
    quantiles read: the sums are not expanded for the distinct counts."""
    cust, prod, st = (sql_name(c) for c in (cfg.customer, cfg.product, cfg.status))
    values = _values("l.high_rows")
    amount = lambda c: f"coalesce(sum({c}), CAST(0 AS {MONEY_TYPE}))"
    return rows.sparkSession.sql(f"""
WITH e AS (
  SELECT /*+ REPARTITION({cust}, {prod}, net_revenue) */ {cust}, {prod}, {st}, gross_revenue, discount_amt, net_revenue,
    spark_partition_id() AS _once FROM {{rows}}),
counts AS (SELECT net_revenue AS x, count(*) AS n FROM e WHERE net_revenue IS NOT NULL GROUP BY net_revenue),
{_limits(rows, cfg, None)},
distincts AS (SELECT count(DISTINCT {cust}) AS unique_customers, count(DISTINCT {prod}) AS unique_products FROM e),
totals AS (
  SELECT count(*) AS n, {amount("gross_revenue")} AS gross, {amount("net_revenue")} AS net,
    {amount("discount_amt")} AS discounts, count_if({st} = {sql_string(CANCELLED_STATUS)}) AS cancelled,
    count_if({st} = {sql_string(REFUNDED_STATUS)}) AS refunded FROM e)
SELECT /*+ BROADCAST(d), BROADCAST(l) */ {", ".join(f"{expr} AS {name}" for name, expr in values.items())}
FROM totals t CROSS JOIN distincts d CROSS JOIN limits l""", rows=rows)


def _scalars(groups: DataFrame, cfg: CleanConfig, median: Decimal | float | None) -> tuple[str, list[str]]:
    """Parts of a WITH clause from ``g`` (the groups) to ``scalars``, the scalar
    KPIs and the rows of each configured band in one row; and the scalars'
    names. Rows above the high-value quantile are counted by the flag where the
    groups have it."""
    cust, prod, st = (sql_name(c) for c in (cfg.customer, cfg.product, cfg.status))
    flagged = "high" in groups.columns

    def rows_of(name: str, column: str, value: str) -> str:
        return f"coalesce(sum(n) FILTER (WHERE set = '{name}' AND {column} = {sql_string(value)}), 0)"

    amounts = ", ".join(f"coalesce(max({c}) FILTER (WHERE set = 'total'), CAST(0 AS {MONEY_TYPE})) AS {c}"
                        for c in ("gross", "net", "discounts"))
    bands = {f"band_{i}": rows_of("band", "revenue_band", label) for i, label in enumerate(cfg.band_labels)
             if "revenue_band" in groups.columns}
    values = _values("t.high" if flagged else "l.high_rows")
    return f"""counts AS (SELECT net_revenue AS x, n FROM g WHERE set = 'value' AND net_revenue IS NOT NULL),
{_limits(groups, cfg, median)},
totals AS (
  SELECT coalesce(max(n) FILTER (WHERE set = 'total'), 0) AS n, {amounts},
    {"coalesce(max(high) FILTER (WHERE set = 'total'), 0) AS high," if flagged else ""}
    {rows_of("status", st, CANCELLED_STATUS)} AS cancelled, {rows_of("status", st, REFUNDED_STATUS)} AS refunded,
    count_if(set = 'customer' AND {cust} IS NOT NULL) AS unique_customers,
    count_if(set = 'product' AND {prod} IS NOT NULL) AS unique_products
    {"".join(f", {expr} AS {name}" for name, expr in bands.items())}
  FROM g),
scalars AS (
  SELECT /*+ BROADCAST(l) */ {", ".join([*(f"{expr} AS {name}" for name, expr in values.items()), *bands])}
  FROM totals t CROSS JOIN limits l)""", list(values)


def _statement(groups: DataFrame, ctes: str, select: str) -> DataFrame:
    """One statement over the groups. ``g`` has a column that depends on the
    partition, so Spark does not paste it into every branch that reads it but
    plans it once, as one exchange that the others reuse."""
    keys = [c for c in groups.columns if c in ("net_revenue", "revenue_band") or c not in
            ("n", "net", "gross", "discounts", "discount_sum", "high")]
    dealt = ", ".join(sql_name(c) for c in keys)
    return groups.sparkSession.sql(
        f"WITH g AS (SELECT /*+ REPARTITION({dealt}) */ *, spark_partition_id() AS _once FROM {{groups}}), {ctes}\n{select}",
        groups=groups)


def overall(groups: DataFrame, cfg: CleanConfig = DEFAULT, median: Decimal | float | None = None) -> DataFrame:
    """All scalar KPIs in one row; a known ``median`` spares the quantiles (the
    groups must have the high-value flag then)."""
    ctes, names = _scalars(groups, cfg, median)
    return _statement(groups, ctes, f"SELECT {', '.join(names)} FROM scalars")


def report_rows(groups: DataFrame, cfg: CleanConfig = DEFAULT, median: Decimal | float | None = None) -> DataFrame:
    """Every family as rows (section, position, key, metric, value).

    Two branches over the groups: one row that holds the scalars and the bands,
    and the groups of the breakdowns with the top customers (cut to k before),
    ranked by one window over the sections. A position ranks the groups of a
    section, not transactions: one task sorts a section's groups, spilling if
    it must, so the breakdown columns are meant to have fewer values than a task
    can sort.
    """
    ctes, names = _scalars(groups, cfg, median)
    bands = [f"band_{i}" for i in range(len(cfg.band_labels))]
    lines = [("overall", i, "NULL", c, c) for i, c in enumerate(names, 1)]
    lines += [("revenue_band_dist", i + 1, sql_string(label), "pct", percent_sql(f"band_{i}", f"({' + '.join(bands)})"))
              for i, label in enumerate(cfg.band_labels)]
    fixed = ", ".join(f"named_struct('section', '{section}', 'position', {position}, 'key', CAST({key} AS STRING), "
                      f"'metric', '{metric}', 'value', CAST({value} AS DOUBLE))"
                      for section, position, key, metric, value in lines)
    net = money_sql("net")
    metrics = {"n": "named_struct('metric', 'transactions', 'value', CAST(n AS DOUBLE))",
               "net": f"named_struct('metric', 'net_revenue', 'value', {net})",
               "discount": "named_struct('metric', 'avg_discount', 'value', "
                           f"{money_sql('discount_sum / CAST(n AS DECIMAL(20,0))', AVG_DISCOUNT_DIGITS)})"}

    def ranked(name: str, source: str, key: str, order: tuple[str, str, str], *wanted: str) -> str:
        first, number, text = order
        return (f"SELECT '{name}' AS section, CAST({key} AS STRING) AS key, CAST({first} AS DOUBLE) AS o1, "
                f"CAST({number} AS DECIMAL(20,0)) AS o2, CAST({text} AS STRING) AS o3, "
                f"array({', '.join(metrics[m] for m in wanted)}) AS metrics FROM ({source}) t")

    def of(name: str) -> str:
        known = [f"{sql_name(c)} IS NOT NULL" for c in set_columns(cfg)[name]] if cfg.drop_null_keys else []
        return f"SELECT * FROM g WHERE {' AND '.join(['set = ' + sql_string(name), *known])}"

    cat, pay, reg, cust = (sql_name(c) for c in (cfg.category, cfg.payment, cfg.region, cfg.customer))
    top = f"{of('customer')} ORDER BY net DESC, {cust} ASC NULLS FIRST LIMIT {int(cfg.top_customers)}"
    parts = [
        ranked("category_revenue", of("category"), cat, (f"-{net}", "NULL", cat), "n", "net", "discount"),
        ranked("monthly_trend", of("month"), "concat_ws('-', year, lpad(CAST(month AS STRING), 2, '0'))",
               ("year", "month", "NULL"), "net"),
        ranked("payment_method_revenue", of("payment"), pay, (f"-{net}", "NULL", pay), "net"),
        ranked("region_performance", of("region"), reg, (f"-{net}", "NULL", reg), "n", "net"),
        ranked("top_customers", top, cust, (f"-{net}", cust, "NULL"), "net")]
    return _statement(groups, f"""{ctes},
sections AS ({" UNION ALL ".join(parts)}),
ordered AS (
  SELECT section, key, metrics, row_number() OVER (
    PARTITION BY section ORDER BY o1 ASC NULLS FIRST, o2 ASC NULLS FIRST, o3 ASC NULLS FIRST) AS position FROM sections)""",
                      f"""SELECT inline(array({fixed})) FROM scalars
UNION ALL
SELECT section, position, key, inline(metrics) FROM ordered""")
