"""Oracle SQL (DuckDB dialect) for every registered query.

The SQL restates each operator's meaning independently of the Spark code:
window dedup, filters, decimal revenue, ``quantile_cont``, and HALF_UP
rounding of ratios written as exact integer arithmetic. Every constant and
column list is written out here, so a wrong one in the engine shows.
"""

from __future__ import annotations

AVG_DISCOUNT_DIGITS, MONEY_DIGITS, NULL_RATE_DIGITS, RATE_DIGITS = 4, 2, 4, 2
BAND_EDGES = (0, 50, 200, 500, 1000)
BAND_LABELS = ("micro", "low", "medium", "high", "premium")
CANCELLED_STATUS, REFUNDED_STATUS = "cancelled", "refunded"
CRITICAL_COLUMNS = ("transaction_id", "customer_id", "price", "quantity", "category", "status", "region")
FILL_VALUES = {"product_name": "Unknown Product", "discount": 0.0}
HIGH_VALUE_QUANTILE, MEDIAN_QUANTILE = 0.9, 0.5
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TOP_CUSTOMERS = 10
RAW_COLUMNS = ("transaction_id", "customer_id", "product_id", "product_name", "category", "price",
               "quantity", "discount", "payment_method", "status", "region", "device_type", "timestamp",
               "is_duplicate_flag")
CLEAN_COLUMNS = (*RAW_COLUMNS, "gross_revenue", "discount_amt", "net_revenue", "month", "year", "quarter",
                 "dow", "revenue_band", "is_high_value")

DEC = "DECIMAL(18,6)"
STRING_COLUMNS = ("product_name", "category", "payment_method", "status", "region",
                  "device_type")
DOUBLE_COLUMNS = ("price", "discount")


def _q(name: str) -> str:
    return f'"{name}"'


def _cols(names) -> str:
    return ", ".join(_q(c) for c in names)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def round_ratio(num: str, den: str, digits: int) -> str:
    """num/den rounded HALF_UP to ``digits`` places, as DOUBLE (num, den >= 0)."""
    scale = 10 ** digits
    return (f"(CAST((2 * CAST({num} AS HUGEINT) * {scale} + CAST({den} AS HUGEINT)) "
            f"// (2 * CAST({den} AS HUGEINT)) AS DOUBLE) / {scale}.0)")


def percent(part: str, whole: str, digits: int) -> str:
    return round_ratio(f"({part}) * 100", f"greatest({whole}, 1)", digits)


def money(expr: str, digits: int = MONEY_DIGITS) -> str:
    return f"CAST(ROUND({expr}, {digits}) AS DOUBLE)"


def avg_decimal(col: str, n: str, digits: int) -> str:
    """Mean of a 6-place decimal column, HALF_UP at ``digits`` places."""
    return round_ratio(f"SUM({col}) * 1000000", f"({n}) * 1000000", digits)


TRANSACTIONS = """transactions AS (
  SELECT
    l.l_orderkey * 10 + l.l_linenumber AS transaction_id,
    CASE WHEN l.l_suppkey % 97 = 0 THEN NULL ELSE o.o_custkey END AS customer_id,
    l.l_partkey AS product_id,
    CASE WHEN l.l_partkey % 50 = 0 THEN 'None' ELSE p.p_name END AS product_name,
    CASE WHEN l.l_suppkey % 89 = 0 THEN NULL ELSE p.p_type END AS category,
    CASE WHEN l.l_suppkey % 83 = 0 THEN CAST(-1.0 AS DOUBLE)
         ELSE floor(l.l_extendedprice / 10) / 100 END AS price,
    CAST((CAST(l.l_quantity AS INTEGER) - 1) % 10
         + CASE WHEN l.l_suppkey % 79 = 0 THEN 0 ELSE 1 END AS INTEGER) AS quantity,
    CASE WHEN l.l_linenumber = 7 THEN CAST(NULL AS DOUBLE)
         ELSE l.l_discount * CASE WHEN l.l_suppkey % 73 = 0 THEN 20 ELSE 1 END + 0.0 END
      AS discount,
    o.o_orderpriority AS payment_method,
    CASE o.o_orderstatus WHEN 'F' THEN 'completed'
         WHEN 'O' THEN CASE WHEN l.l_returnflag = 'A' THEN 'cancelled' ELSE 'pending' END
         ELSE 'refunded' END AS status,
    r.r_name AS region,
    c.c_mktsegment AS device_type,
    l.l_shipdate AS "timestamp",
    FALSE AS is_duplicate_flag,
    l.l_extendedprice AS _tb_extendedprice
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""


def _band_case(col: str) -> str:
    parts = [f"WHEN {col} IS NULL OR {col} < {BAND_EDGES[0]} THEN NULL"]
    for edge, label in zip(BAND_EDGES[1:], BAND_LABELS[:-1]):
        parts.append(f"WHEN {col} < {edge} THEN {_lit(label)}")
    return "CASE " + " ".join(parts) + f" ELSE {_lit(BAND_LABELS[-1])} END"


def clean_ctes(src: str, p: str = "") -> str:
    """CTEs {p}prepared -> {p}deduped -> {p}critical -> {p}filled -> {p}positive ->
    {p}clipped -> {p}revenue -> {p}calendar -> {p}enriched -> {p}clean_table."""
    tokens = ", ".join(_lit(t) for t in NA_TOKENS)
    na = ", ".join(f"CASE WHEN {_q(c)} IN ({tokens}) THEN NULL ELSE {_q(c)} END AS {_q(c)}"
                   for c in STRING_COLUMNS)
    crit = " AND ".join(
        f"{_q(c)} IS NOT NULL" + (f" AND NOT isnan({_q(c)})" if c in DOUBLE_COLUMNS else "")
        for c in CRITICAL_COLUMNS)
    fill_name = _lit(FILL_VALUES["product_name"])
    fill_disc = float(FILL_VALUES["discount"])
    enriched_cols = CLEAN_COLUMNS[:-1]
    flag = (f"CAST(net_revenue > (SELECT quantile_cont(net_revenue, {HIGH_VALUE_QUANTILE}) "
            f"FROM {p}enriched) AS INTEGER) AS is_high_value")
    return f""",
{p}prepared AS (SELECT * REPLACE ({na}) FROM {src}),
{p}deduped AS (
  SELECT {_cols(RAW_COLUMNS)} FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY "timestamp" ASC NULLS FIRST,
      _tb_extendedprice ASC NULLS FIRST, product_id ASC NULLS FIRST) AS _rn
    FROM {p}prepared) t
  WHERE _rn = 1),
{p}critical AS (SELECT * FROM {p}deduped WHERE {crit}),
{p}filled AS (SELECT * REPLACE (coalesce(product_name, {fill_name}) AS product_name,
    CASE WHEN discount IS NULL OR isnan(discount) THEN CAST({fill_disc} AS DOUBLE)
         ELSE discount END AS discount) FROM {p}critical),
{p}positive AS (SELECT * FROM {p}filled
  WHERE price > 0 AND price < CAST('inf' AS DOUBLE) AND quantity > 0),
{p}clipped AS (SELECT * REPLACE (least(greatest(discount, CAST(0.0 AS DOUBLE)),
    CAST(1.0 AS DOUBLE)) AS discount) FROM {p}positive),
{p}revenue AS (
  SELECT *, CAST(gross_revenue - discount_amt AS {DEC}) AS net_revenue FROM (
    SELECT *, CAST(gross_revenue * CAST(discount AS {DEC}) AS {DEC}) AS discount_amt FROM (
      SELECT *, CAST(CAST(price AS {DEC}) * quantity AS {DEC}) AS gross_revenue
      FROM {p}clipped) a) b),
{p}calendar AS (SELECT *, CAST(month("timestamp") AS INTEGER) AS month,
    CAST(year("timestamp") AS INTEGER) AS year,
    CAST(quarter("timestamp") AS INTEGER) AS quarter,
    CAST(dayofweek("timestamp") + 1 AS INTEGER) AS dow FROM {p}revenue),
{p}enriched AS (SELECT {_cols(enriched_cols[:-1])}, {_band_case("net_revenue")} AS revenue_band
  FROM {p}calendar),
{p}clean_table AS (SELECT *, {flag} FROM {p}enriched)"""


BASE = "WITH " + TRANSACTIONS + clean_ctes("transactions")


def _with(select: str) -> str:
    return BASE + "\n" + select


def _null_profile_select(src: str) -> str:
    counts = []
    for c in RAW_COLUMNS:
        cond = f"{_q(c)} IS NULL" + (f" OR isnan({_q(c)})" if c in DOUBLE_COLUMNS else "")
        counts.append(f"CAST(count_if({cond}) AS BIGINT) AS null_{c}")
    total = " + ".join(f"count_if({_q(c)} IS NULL"
                       + (f" OR isnan({_q(c)})" if c in DOUBLE_COLUMNS else "") + ")"
                       for c in RAW_COLUMNS)
    return (f"SELECT count(*) AS rows, {', '.join(counts)}, CAST({total} AS BIGINT) AS null_cells, "
            f"CAST(count(*) * {len(RAW_COLUMNS)} AS BIGINT) AS cells FROM {src}")


def _null_cells(columns, doubles) -> str:
    return " + ".join(f"count_if({_q(c)} IS NULL"
                      + (f" OR isnan({_q(c)})" if c in doubles else "") + ")"
                      for c in columns)


def _status_rates(n: str = "count(*)") -> str:
    return (f"{percent(f'count_if(status = {_lit(CANCELLED_STATUS)})', n, RATE_DIGITS)} "
            f"AS cancellation_rate, "
            f"{percent(f'count_if(status = {_lit(REFUNDED_STATUS)})', n, RATE_DIGITS)} "
            f"AS refund_rate")


def _overall_select() -> str:
    return f"""SELECT count(*) AS total_transactions,
  {money('coalesce(SUM(gross_revenue), 0)')} AS total_gross_revenue,
  {money('coalesce(SUM(net_revenue), 0)')} AS total_net_revenue,
  {money('coalesce(SUM(discount_amt), 0)')} AS total_discount_amt,
  {avg_decimal('net_revenue', 'count(*)', MONEY_DIGITS)} AS avg_order_value,
  count(DISTINCT customer_id) AS unique_customers,
  count(DISTINCT product_id) AS unique_products,
  {percent('SUM(is_high_value)', 'count(*)', RATE_DIGITS)} AS high_value_txn_pct,
  {_status_rates()},
  CAST(ROUND(quantile_cont(net_revenue, {MEDIAN_QUANTILE}), {MONEY_DIGITS}) AS DOUBLE)
    AS median_order_value
FROM clean_table"""


def _band_dist_select() -> str:
    values = ", ".join(f"({_lit(label)}, {i + 1})" for i, label in enumerate(BAND_LABELS))
    return f"""SELECT b.revenue_band, CAST(b.band_rank AS INTEGER) AS band_rank,
  CAST(coalesce(c.n, 0) AS BIGINT) AS transactions,
  {percent('coalesce(c.n, 0)', 't.total', RATE_DIGITS)} AS pct
FROM (VALUES {values}) b(revenue_band, band_rank)
LEFT JOIN (SELECT revenue_band, count(*) AS n FROM clean_table
           WHERE revenue_band IS NOT NULL GROUP BY revenue_band) c USING (revenue_band)
CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS total FROM clean_table
            WHERE revenue_band IS NOT NULL) t"""


def _replicate_select(copies: int) -> str:
    union = " UNION ALL ".join(["SELECT * FROM transactions"] * copies)
    return ("WITH " + TRANSACTIONS + f",\nreplicated AS ({union})"
            + clean_ctes("replicated", "r_") + f"""
SELECT (SELECT count(*) FROM replicated) AS rows_in,
  count(*) AS rows_clean,
  {money('coalesce(SUM(net_revenue), 0)')} AS total_net_revenue
FROM r_enriched""")


def _exact_quantile_select(src: str, col: str, p: float, alias: str) -> str:
    """Linear interpolation between the order statistics at floor/ceil((n-1)p),
    in exact decimal arithmetic, rounded HALF_UP to 6 places."""
    pos = f"(q.n - 1) * CAST({p} AS DECIMAL(10,6))"
    return f"""SELECT CAST(ROUND(a.v + (b.v - a.v) * ({pos} - floor({pos})), 6) AS DOUBLE) AS {alias},
  q.n AS rows
FROM (SELECT count(*) AS n FROM {src}) q
JOIN (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS rk FROM {src}) a
  ON a.rk = CAST(floor({pos}) AS BIGINT)
JOIN (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS rk FROM {src}) b
  ON b.rk = least(CAST(floor({pos}) AS BIGINT) + 1, q.n - 1)"""


def _parse_timestamp_select() -> str:
    return """SELECT transaction_id, ts_text,
  try_strptime(substr(ts_text, 1, 19), '%Y-%m-%d %H:%M:%S') AS "timestamp"
FROM (SELECT transaction_id,
    CASE WHEN transaction_id % 10 = 3 THEN strftime("timestamp", '%Y-%m-%d %H:%M:%S') || '.123'
         WHEN transaction_id % 10 = 5 THEN strftime("timestamp", '%Y-%m-%dT%H:%M:%S')
         ELSE strftime("timestamp", '%Y-%m-%d %H:%M:%S') END AS ts_text
  FROM transactions) t"""


def _na_select() -> str:
    listed = ", ".join(_lit(t) for t in NA_TOKENS)
    name = (f"CASE WHEN product_id % 7 = 0 THEN ([{listed}])[CAST(product_id // 7 % {len(NA_TOKENS)} AS INTEGER) + 1] "
            f"ELSE product_name END")
    cols = ", ".join(f"CASE WHEN {_q(c)} IN ({listed}) THEN NULL ELSE {_q(c)} END AS {_q(c)}" if c in STRING_COLUMNS
                     else _q(c) for c in RAW_COLUMNS)
    return f"SELECT {cols} FROM (SELECT * REPLACE ({name} AS product_name) FROM transactions) t"


def _report_select() -> str:
    """The report's rows; positions rank each section's groups by its own order."""
    scalars = ("total_transactions", "total_gross_revenue", "total_net_revenue", "total_discount_amt",
               "avg_order_value", "unique_customers", "unique_products", "high_value_txn_pct",
               "cancellation_rate", "refund_rate", "median_order_value")
    overall = " UNION ALL ".join(
        f"SELECT 'overall' AS section, {i} AS position, CAST(NULL AS VARCHAR) AS key, '{c}' AS metric, "
        f"CAST({c} AS DOUBLE) AS value FROM o" for i, c in enumerate(scalars, 1))

    def ranked(section: str, table: str, order: str, key: str, metrics: tuple[str, ...]) -> str:
        return " UNION ALL ".join(
            f"SELECT '{section}', row_number() OVER (ORDER BY {order}), CAST({key} AS VARCHAR), '{m}', "
            f"CAST({m} AS DOUBLE) FROM ({table}) t" for m in metrics)

    net = money("SUM(net_revenue)")
    category = (f"SELECT category, count(*) AS transactions, {net} AS net_revenue, "
                f"{avg_decimal(f'CAST(discount AS {DEC})', 'count(*)', AVG_DISCOUNT_DIGITS)} AS avg_discount "
                f"FROM clean_table GROUP BY category")
    month = f"SELECT year, month, {net} AS net_revenue FROM clean_table GROUP BY year, month"
    payment = f"SELECT payment_method, {net} AS net_revenue FROM clean_table GROUP BY payment_method"
    region = (f"SELECT region, count(*) AS transactions, {net} AS net_revenue "
              f"FROM clean_table GROUP BY region")
    top = (f"SELECT customer_id, {net} AS net_revenue FROM clean_table GROUP BY customer_id "
           f"ORDER BY SUM(net_revenue) DESC, customer_id ASC NULLS FIRST LIMIT {TOP_CUSTOMERS}")
    by_net = "net_revenue DESC, {} ASC NULLS FIRST"
    parts = [
        overall,
        ranked("category_revenue", category, by_net.format("category"), "category",
               ("transactions", "net_revenue", "avg_discount")),
        ranked("monthly_trend", month, "year ASC NULLS FIRST, month ASC NULLS FIRST",
               "year || '-' || lpad(CAST(month AS VARCHAR), 2, '0')", ("net_revenue",)),
        ranked("payment_method_revenue", payment, by_net.format("payment_method"), "payment_method", ("net_revenue",)),
        ranked("region_performance", region, by_net.format("region"), "region", ("transactions", "net_revenue")),
        ranked("revenue_band_dist", _band_dist_select(), "band_rank", "revenue_band", ("pct",)),
        ranked("top_customers", top, by_net.format("customer_id"), "customer_id", ("net_revenue",)),
    ]
    return BASE + f", o AS ({_overall_select()})\n" + " UNION ALL ".join(parts)


RUNS = """WITH e AS (SELECT ts, event_type, event_id, CAST(value AS DECIMAL(12,2)) AS v FROM events),
g AS (SELECT CASE event_type WHEN 'click' THEN 'pandas' WHEN 'view' THEN 'pyspark' ELSE event_type END AS framework,
    day(ts) AS d, hour(ts) // 6 AS part, max(ts) AS finished_at, count(*) AS n, count_if(v > 20) AS kept,
    coalesce(sum(v) FILTER (event_id % 4 = 0), 0) AS t0, coalesce(sum(v) FILTER (event_id % 4 = 1), 0) AS t1,
    coalesce(sum(v) FILTER (event_id % 4 = 2), 0) AS t2, coalesce(sum(v) FILTER (event_id % 4 = 3), 0) AS t3,
    sum(v) AS total FROM e GROUP BY ALL),
runs AS (SELECT framework || '-D' || d || '-' || part AS run_id, finished_at, framework, 'D' || d AS scale_label,
    CASE WHEN n % 5 <> 0 THEN 'SUCCESS' ELSE 'ERROR' END AS status, n % 5 <> 0 AS ok,
    CAST(d * 10000 AS BIGINT) AS raw_rows, kept AS clean_rows, 8 AS cores_used,
    CAST(t0 AS DOUBLE) AS time_extract_s, CAST(t1 AS DOUBLE) AS time_transform_s, CAST(t2 AS DOUBLE) AS time_load_s,
    CAST(t3 AS DOUBLE) AS time_analytics_s, CASE WHEN n % 5 <> 0 THEN CAST(total AS DOUBLE) END AS time_total_s,
    {drop} AS drop_pct FROM g),
newest AS (SELECT * FROM runs QUALIFY row_number() OVER (
    PARTITION BY framework, scale_label ORDER BY finished_at DESC, run_id DESC) = 1)
""".replace("{drop}", percent("n - kept", "n", RATE_DIGITS))
STAGES = ("extract", "transform", "load", "analytics")
_PAIRS = ("FROM (SELECT * FROM newest WHERE framework = 'pandas') b "
          "JOIN (SELECT * FROM newest WHERE framework = 'pyspark') c USING (scale_label)")


def _run_sql() -> dict[str, str]:
    def ok(c: str, t: str = "") -> str:
        p = f"{t}." if t else ""
        return f"CASE WHEN {p}ok THEN {p}{c} END"

    stages = ", ".join(f"{ok(f'time_{s}_s')} AS time_{s}_s" for s in STAGES)
    sides = ", ".join(f"{ok(f'time_{s}_s', t)} AS {p}_{s}_s" for t, p in (("b", "base"), ("c", "cand")) for s in STAGES)
    base, cand = ok("time_total_s", "b"), ok("time_total_s", "c")
    ratio = f"({base}) / greatest({cand}, 1e-6)"
    unpivot = " UNION ALL ".join(
        f"SELECT framework, scale_label, '{s}' AS stage, time_{s}_s AS seconds FROM runs "
        f"WHERE ok AND raw_rows = (SELECT max(raw_rows) FROM runs WHERE ok)" for s in STAGES)
    return {
        "run_summary": RUNS + f"""SELECT framework, scale_label, status, {ok('raw_rows')} AS raw_rows,
  {ok('clean_rows')} AS clean_rows, cores_used, {stages}, {ok('time_total_s')} AS time_total_s,
  CAST(NULL AS DOUBLE) AS memory_peak_mb, CASE WHEN ok THEN CAST(0.5 AS DOUBLE) END AS null_rate_before,
  CASE WHEN ok THEN CAST(0.0 AS DOUBLE) END AS null_rate_after, {ok('drop_pct')} AS drop_pct FROM runs""",
        "run_align": RUNS + f"""SELECT scale_label, b.status AS base_status, b.raw_rows AS base_raw_rows,
  {base} AS base_total_s, c.status AS cand_status, c.raw_rows AS cand_raw_rows, {cand} AS cand_total_s, {sides}
{_PAIRS}""",
        "run_speedup": RUNS + f"""SELECT scale_label, b.raw_rows, {base} AS base_total_s, {cand} AS cand_total_s,
  CASE WHEN b.ok AND c.ok THEN {ratio} END AS speedup,
  CASE WHEN b.ok AND c.ok THEN CASE WHEN {ratio} > 1.0 THEN 'faster' ELSE 'slower' END END AS mark {_PAIRS}""",
        "run_throughput": RUNS + """SELECT framework, scale_label, raw_rows, time_total_s,
  raw_rows / greatest(time_total_s, 1e-6) / 1000.0 AS k_rows_per_s FROM runs WHERE ok""",
        "run_stage_breakdown": RUNS + unpivot,
        "run_quality": RUNS + """SELECT framework, scale_label, raw_rows, drop_pct, CAST(0.5 AS DOUBLE) AS null_rate_before,
  CAST(0.0 AS DOUBLE) AS null_rate_after FROM runs WHERE ok""",
        "run_ranked": RUNS + """SELECT framework, CAST(row_number() OVER (PARTITION BY framework
  ORDER BY time_total_s ASC NULLS LAST, run_id ASC) AS INTEGER) AS place, run_id, time_total_s FROM runs""",
    }


def _pipeline_run_select() -> str:
    return _with(f"""SELECT 'SUCCESS' AS status, b.rows AS raw_rows, o.total_transactions AS clean_rows,
  b.rows AS rows_before, o.total_transactions AS rows_after,
  {percent('b.rows - o.total_transactions', 'b.rows', RATE_DIGITS)} AS drop_pct,
  {round_ratio('b.nulls * 100', f'greatest(b.rows * {len(RAW_COLUMNS)}, 1)', NULL_RATE_DIGITS)} AS null_rate_before,
  {round_ratio('a.nulls * 100', f'greatest(o.total_transactions * {len(CLEAN_COLUMNS)}, 1)', NULL_RATE_DIGITS)} AS null_rate_after,
  o.total_net_revenue, CAST(o.unique_customers AS DOUBLE) AS unique_customers, o.median_order_value,
  o.high_value_txn_pct, o.total_transactions AS clean_rows_written
FROM (SELECT count(*) AS rows, {_null_cells(RAW_COLUMNS, DOUBLE_COLUMNS)} AS nulls FROM prepared) b,
     (SELECT {_null_cells(CLEAN_COLUMNS, DOUBLE_COLUMNS)} AS nulls FROM clean_table) a,
     ({_overall_select()}) o""")


CSV_QUOTING = """SELECT p_partkey AS product_id, CASE p_partkey % 5 WHEN 0 THEN 'say "' || p_name || '", please'
  WHEN 1 THEN '  ' || p_name || '  ' WHEN 2 THEN p_name || ',,' WHEN 3 THEN '"' || p_name ELSE p_name END AS product_name,
  p_retailprice AS price FROM part"""


RUN_RECORDS = f"""SELECT * FROM (SELECT l AS scale_label, 'SUCCESS' AS status, CAST(NULL AS BOOLEAN) AS names_the_error,
    b.rows AS raw_rows, o.n AS clean_rows, TRUE AS has_size, TRUE AS has_parts, FALSE AS staged_left,
    TRUE AS stages_within_total, TRUE AS stamped
  FROM (VALUES ('cache'), ('table')) v(l), (SELECT count(*) AS rows FROM prepared) b, (SELECT count(*) AS n FROM clean_table) o
  UNION ALL SELECT 'failed', 'ERROR', TRUE, NULL, NULL, NULL, NULL, NULL, NULL, TRUE) t"""

RUN_APPEND_TWICE = RUNS + """SELECT run_id, framework, CASE framework WHEN 'pandas' THEN 16 ELSE 8 END AS cores_used,
  raw_rows FROM runs"""

CSV_REJECTS = """, d AS (SELECT CASE WHEN transaction_id % 17 = 0 THEN 'columns' WHEN transaction_id % 13 = 0 THEN 'type price'
    WHEN transaction_id % 11 = 0 THEN 'range price' END AS reason,
    CASE WHEN transaction_id % 17 = 0 THEN 2 ELSE 1 END AS lines FROM transactions),
r AS (SELECT reason, CAST(sum(lines) AS BIGINT) AS rows FROM d GROUP BY reason)
SELECT reason, rows, {pct} AS pct FROM r""".replace("{pct}", percent("rows", "(SELECT sum(rows) FROM r)", RATE_DIGITS))

WRITE_IF_ABSENT = """SELECT s AS step, (SELECT count(*) FROM part) AS rows, (SELECT CAST(sum(p_partkey) AS BIGINT) FROM part) AS ids
FROM (VALUES ('written'), ('skipped'), ('repaired')) v(s)"""


MONEY_COLUMNS = ("gross_revenue", "discount_amt", "net_revenue")


def _money_as_double(select: str, columns=MONEY_COLUMNS) -> str:
    """Report the exact decimal money columns as DOUBLE (as the queries do)."""
    cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({cast}) FROM ({select}) q"


def oracle_sql() -> dict[str, str]:
    raw = _cols(RAW_COLUMNS)
    quality_after_cols = CLEAN_COLUMNS
    return {
        "na_token_normalise": _with(_na_select()),
        "parse_timestamp": _with(_parse_timestamp_select()),
        "exact_dedup": _with(f"SELECT DISTINCT {raw} FROM (SELECT {raw} FROM transactions "
                             f"UNION ALL SELECT {raw} FROM transactions) t"),
        "dedup_by_key": _with("SELECT * FROM deduped"),
        "drop_critical_nulls": _with("SELECT * FROM critical"),
        "fill_defaults": _with("SELECT * FROM filled"),
        "positive_filter": _with("SELECT * FROM positive"),
        "clip_discount": _with("SELECT * FROM clipped"),
        "revenue_columns": _with(_money_as_double("SELECT * FROM revenue")),
        "calendar_parts": _with(_money_as_double("SELECT * FROM calendar")),
        "day_of_week": _with('SELECT transaction_id, "timestamp", dow AS dow_sunday, '
                             'CAST(isodow("timestamp") - 1 AS INTEGER) AS dow_monday '
                             'FROM calendar'),
        "revenue_band": _with(_money_as_double("SELECT * FROM enriched")),
        "high_value_flag": _with("SELECT transaction_id, CAST(net_revenue AS DOUBLE) AS net_revenue, "
                                 "is_high_value FROM clean_table"),
        "clean_table": _with(_money_as_double(f"SELECT {_cols(CLEAN_COLUMNS)} FROM clean_table")),
        "null_profile": _with(_null_profile_select("prepared")),
        "quality_report": _with(f"""SELECT b.rows_before, a.rows_after,
  b.rows_before - a.rows_after AS rows_dropped,
  {percent('b.rows_before - a.rows_after', 'b.rows_before', RATE_DIGITS)} AS drop_pct,
  {round_ratio('b.nulls * 100', f'greatest(b.rows_before * {len(RAW_COLUMNS)}, 1)',
               NULL_RATE_DIGITS)} AS null_rate_before,
  {round_ratio('a.nulls * 100', f'greatest(a.rows_after * {len(quality_after_cols)}, 1)',
               NULL_RATE_DIGITS)} AS null_rate_after
FROM (SELECT count(*) AS rows_before, {_null_cells(RAW_COLUMNS, DOUBLE_COLUMNS)} AS nulls
      FROM prepared) b,
     (SELECT count(*) AS rows_after,
             {_null_cells(quality_after_cols, DOUBLE_COLUMNS)} AS nulls FROM clean_table) a"""),
        "overall_kpis": _with(_overall_select()),
        "distinct_counts": _with("SELECT count(DISTINCT customer_id) AS unique_customers, "
                                 "count(DISTINCT product_id) AS unique_products FROM clean_table"),
        "median_order_value": _with(
            f"SELECT CAST(ROUND(quantile_cont(net_revenue, {MEDIAN_QUANTILE}), {MONEY_DIGITS}) "
            f"AS DOUBLE) AS median_order_value FROM enriched"),
        "p90_threshold": _with(_exact_quantile_select("enriched", "net_revenue",
                                                      HIGH_VALUE_QUANTILE, "p90_threshold")),
        "status_counts": _with("SELECT status, count(*) AS transactions FROM enriched "
                               "GROUP BY status"),
        "status_rates": _with(f"SELECT {_status_rates()} FROM enriched"),
        "category_revenue": _with(f"""SELECT category, count(*) AS transactions,
  {money('SUM(net_revenue)')} AS net_revenue,
  {avg_decimal(f'CAST(discount AS {DEC})', 'count(*)', AVG_DISCOUNT_DIGITS)} AS avg_discount
FROM enriched GROUP BY category"""),
        "monthly_trend": _with(f"SELECT year, month, {money('SUM(net_revenue)')} AS net_revenue "
                               f"FROM enriched GROUP BY year, month"),
        "payment_method_revenue": _with(
            f"SELECT payment_method, {money('SUM(net_revenue)')} AS net_revenue "
            f"FROM enriched GROUP BY payment_method"),
        "region_performance": _with(
            f"SELECT region, count(*) AS transactions, {money('SUM(net_revenue)')} AS net_revenue "
            f"FROM enriched GROUP BY region"),
        "revenue_band_dist": _with(_band_dist_select()),
        "top_customers": _with(
            f"SELECT customer_id, {money('SUM(net_revenue)')} AS net_revenue FROM enriched "
            f"GROUP BY customer_id ORDER BY SUM(net_revenue) DESC, customer_id ASC NULLS FIRST "
            f"LIMIT {TOP_CUSTOMERS}"),
        "approx_quantiles": _with("SELECT quantile_disc(quantity, 0.45) AS quantity_p45, "
                                  "quantile_disc(quantity, 0.85) AS quantity_p85, "
                                  "TRUE AS net_p50_within_error, TRUE AS net_p90_within_error FROM enriched"),
        "kpi_report": _report_select(),
        "pipeline_run": _pipeline_run_select(),
        **_run_sql(),
        "run_records": _with(RUN_RECORDS),
        "run_append_twice": RUN_APPEND_TWICE,
        "csv_rejects": "WITH " + TRANSACTIONS + CSV_REJECTS,
        "write_if_absent": WRITE_IF_ABSENT,
        "incremental_clean": _with(_money_as_double(f"SELECT {_cols(CLEAN_COLUMNS)} FROM clean_table")),
        "sketch_ranges": _with("SELECT year, count(*) AS transactions, TRUE AS rows_agree, TRUE AS customers_within, "
                               "TRUE AS products_within, TRUE AS p50_within, TRUE AS p90_within FROM enriched GROUP BY year"),
        "csv_quoting_round_trip": CSV_QUOTING,
        "partitioned_round_trip": _with(_money_as_double(f"SELECT {_cols(CLEAN_COLUMNS)} FROM clean_table")),
        "replicate_union": _replicate_select(3),
        "csv_round_trip": _with(_money_as_double("SELECT * FROM enriched")),
        "parquet_round_trip": _with(_money_as_double(
            f"SELECT {_cols(CLEAN_COLUMNS)} FROM clean_table")),
    }
