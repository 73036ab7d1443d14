"""Declared schemas: raw transactions, the clean table and run metrics."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw transactions as read from CSV. Integers are long/int, money is read as
# double (never float: 19.99 * 3 must not become 59.96999931), the timestamp
# stays text until the tolerant parse.
RAW_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType(), True),
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("product_id", T.LongType(), True),
    T.StructField("product_name", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("price", T.DoubleType(), True),
    T.StructField("quantity", T.IntegerType(), True),
    T.StructField("discount", T.DoubleType(), True),
    T.StructField("payment_method", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("device_type", T.StringType(), True),
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("is_duplicate_flag", T.BooleanType(), True),
])

RAW_COLUMNS = tuple(f.name for f in RAW_SCHEMA.fields)

# Columns the enrichment adds, in order (14 raw + 9 derived = 23).
DERIVED_COLUMNS = ("gross_revenue", "discount_amt", "net_revenue", "month",
                   "year", "quarter", "dow", "revenue_band", "is_high_value")

CLEAN_COLUMNS = RAW_COLUMNS + DERIVED_COLUMNS

QUALITY_SCHEMA = T.StructType([
    T.StructField("rows_before", T.LongType(), True),
    T.StructField("rows_after", T.LongType(), True),
    T.StructField("rows_dropped", T.LongType(), True),
    T.StructField("drop_pct", T.DoubleType(), True),
    T.StructField("null_rate_before", T.DoubleType(), True),
    T.StructField("null_rate_after", T.DoubleType(), True),
])

# One row per pipeline run. ``status`` is SUCCESS, FAILED (OOM) or ERROR.
# A run has its own id and end time; the history may hold several runs of one
# (framework, scale). ``kpis`` holds the scalar KPIs by name.
RUN_METRICS_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), True),
    T.StructField("finished_at", T.TimestampType(), True),
    T.StructField("framework", T.StringType(), True),
    T.StructField("scale_label", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("error_msg", T.StringType(), True),
    T.StructField("raw_rows", T.LongType(), True),
    T.StructField("clean_rows", T.LongType(), True),
    T.StructField("cores_used", T.IntegerType(), True),
    T.StructField("time_extract_s", T.DoubleType(), True),
    T.StructField("time_transform_s", T.DoubleType(), True),
    T.StructField("time_load_s", T.DoubleType(), True),
    T.StructField("time_analytics_s", T.DoubleType(), True),
    T.StructField("time_total_s", T.DoubleType(), True),
    T.StructField("memory_peak_mb", T.DoubleType(), True),
    T.StructField("quality", QUALITY_SCHEMA, True),
    T.StructField("kpis", T.MapType(T.StringType(), T.DoubleType()), True),
])
