"""Registered queries: one per operator of the inventory, each over the whole
shared test tables at ``sf_dir`` (transactions are derived from lineitem,
orders, part, customer, nation and region by ``sources.tables``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.config import MEDIAN_QUANTILE, MONEY_DIGITS, MONEY_TYPE
from kassa.functions import day_of_week, dealt, percent, round_money
from kassa.operators import compare, groups, kpis, sketches
from kassa.operators.clean import (clip_discount, dedup, drop_critical_nulls, fill_defaults,
                                   positive_filter)
from kassa.operators.dedup import exact_dedup
from kassa.operators.enrich import calendar_parts, revenue_columns
from kassa.operators.normalize import normalize_na_tokens, parse_timestamps, prepare
from kassa.operators.quality import judged_rows, null_profile, quality_one_pass
from kassa.operators.quantile import approx_quantiles
from kassa.operators.replicate import replicate
from kassa.plans.run import run_pipeline
from kassa.plans.stages import enriched, flag, threshold_row
from kassa.schema import CLEAN_COLUMNS, RAW_COLUMNS, RAW_SCHEMA
from kassa.session import delete_path, held, holding, path_exists, release_with, scratch_path
from kassa.sinks.files import append_run_metrics, write_csv, write_parquet, written_size_mb
from kassa.sinks.incremental import apply_batch, read_incremental
from kassa.sources.csv import read_transactions_csv, reject_report, split_csv
from kassa.sources.metrics import read_run_metrics
from kassa.sources.parquet import read_clean
from kassa.sources.tables import TABLES_CONFIG, TIE_BREAK_COLUMN, transactions_from_tables

CFG = TABLES_CONFIG
Query = Callable[[SparkSession, str], DataFrame]


def _tx(spark: SparkSession, sf: str) -> DataFrame:
    return transactions_from_tables(spark, sf)


def _prepared(spark, sf):
    return prepare(_tx(spark, sf), CFG)


def _deduped(spark, sf):
    return dedup(_prepared(spark, sf), CFG)


def _critical(spark, sf):
    # The key is critical: null keys leave before the dedup shuffle (same
    # result, and a hot null key never reaches the exchange).
    keyed = _prepared(spark, sf).where(F.col(CFG.key).isNotNull())
    return drop_critical_nulls(dedup(keyed, CFG), CFG.critical)


def _filled(spark, sf):
    return fill_defaults(_critical(spark, sf), CFG.fills)


def _positive(spark, sf):
    return positive_filter(_filled(spark, sf), CFG.price, CFG.quantity)


def _clipped(spark, sf):
    return clip_discount(_positive(spark, sf), CFG.discount, *CFG.discount_range)


def _enriched(spark, sf):
    return enriched(_tx(spark, sf), CFG)


def _clean_table(spark, sf):
    """The flagged table: the joins and the dedup run once, for the rows and
    for the threshold that they are compared with."""
    e = held(_enriched(spark, sf))
    return flag(e, threshold_row(e, CFG))


# --- sources and normalisation ---------------------------------------------

def na_token_normalise(spark, sf):
    """Every token occurs as a product name (one product in seven)."""
    tokens = F.array(*[F.lit(t) for t in CFG.na_tokens])
    name = F.when(F.col("product_id") % 7 == 0, F.get(
        tokens, (F.floor(F.col("product_id") / 7) % len(CFG.na_tokens)).cast("int"))).otherwise(F.col("product_name"))
    dirty = _tx(spark, sf).withColumn("product_name", name)
    return normalize_na_tokens(dirty, CFG.na_tokens).select(*RAW_COLUMNS)


def parse_timestamp(spark, sf):
    """Timestamps as text (some with a sub-second tail, some with an ISO
    ``T``), parsed back tolerantly."""
    tx = _tx(spark, sf)
    ts = F.col("timestamp")
    tail = F.col("transaction_id") % 10
    text = (F.when(tail == 3, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(".123")))
             .when(tail == 5, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
             .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
    out = tx.select("transaction_id", text.alias("ts_text"), text.alias("timestamp"))
    return parse_timestamps(out, "timestamp", CFG.timestamp_format)


# --- dedup and cleaning ------------------------------------------------------

def exact_dedup_q(spark, sf):
    tx = _tx(spark, sf).select(*RAW_COLUMNS)
    return exact_dedup(replicate(tx, 2))


def dedup_by_key_q(spark, sf):
    return _deduped(spark, sf)


def drop_critical_nulls_q(spark, sf):
    return _critical(spark, sf)


def fill_defaults_q(spark, sf):
    return _filled(spark, sf)


def positive_filter_q(spark, sf):
    return _positive(spark, sf)


def clip_discount_q(spark, sf):
    return _clipped(spark, sf)


# --- enrichment --------------------------------------------------------------

def revenue_columns_q(spark, sf):
    return revenue_columns(_clipped(spark, sf), CFG)


def calendar_parts_q(spark, sf):
    return calendar_parts(revenue_columns(_clipped(spark, sf), CFG), CFG)


def day_of_week_q(spark, sf):
    return _clipped(spark, sf).select(
        "transaction_id", "timestamp", day_of_week("timestamp").alias("dow_sunday"),
        day_of_week("timestamp", "monday").alias("dow_monday"))


def revenue_band_q(spark, sf):
    return _enriched(spark, sf)


def high_value_flag_q(spark, sf):
    return _clean_table(spark, sf).select("transaction_id", "net_revenue", "is_high_value")


def clean_table_q(spark, sf):
    return _clean_table(spark, sf)


# --- quality -----------------------------------------------------------------

def null_profile_q(spark, sf):
    return null_profile(_prepared(spark, sf), RAW_COLUMNS)


def quality_report_q(spark, sf):
    """Before and after from one scan and one shuffle by key."""
    return quality_one_pass(_prepared(spark, sf), CFG, RAW_COLUMNS, CLEAN_COLUMNS)


# --- KPIs --------------------------------------------------------------------

def overall_kpis(spark, sf):
    return groups.overall_of_rows(_enriched(spark, sf), CFG)


def distinct_counts_q(spark, sf):
    return kpis.distinct_counts(_enriched(spark, sf), CFG)


def median_order_value(spark, sf):
    median = F.coalesce(F.col("median"), F.lit(0).cast("decimal(38,9)"))
    return threshold_row(_enriched(spark, sf), CFG).select(round_money(median, MONEY_DIGITS).alias("median_order_value"))


def p90_threshold(spark, sf):
    return threshold_row(_enriched(spark, sf), CFG).select(
        round_money("high_value", 6).alias("p90_threshold"), "rows")


def status_counts_q(spark, sf):
    return kpis.status_counts(_enriched(spark, sf), CFG)


def status_rates_q(spark, sf):
    return kpis.status_rates(_enriched(spark, sf), CFG)


def category_revenue_q(spark, sf):
    return kpis.category_revenue(_enriched(spark, sf), CFG)


def monthly_trend_q(spark, sf):
    return kpis.monthly_trend(_enriched(spark, sf), CFG)


def payment_method_revenue_q(spark, sf):
    return kpis.payment_method_revenue(_enriched(spark, sf), CFG)


def region_performance_q(spark, sf):
    return kpis.region_performance(_enriched(spark, sf), CFG)


def revenue_band_dist_q(spark, sf):
    return kpis.revenue_band_dist(_enriched(spark, sf), CFG)


def top_customers_q(spark, sf):
    return kpis.top_customers(_enriched(spark, sf), CFG)


def approx_quantiles_q(spark, sf):
    """Greenwald-Khanna quantiles with a rank error of 0.001. At 0.45 and 0.85
    of quantity no value boundary lies within that error, so the sketch must
    give the exact values; for net revenue the true rank of what it gives is
    compared with the error."""
    e = _enriched(spark, sf)
    error, probs = 0.001, (MEDIAN_QUANTILE, CFG.high_value_quantile)
    few = approx_quantiles(e, "quantity", [0.45, 0.85], error)
    net = approx_quantiles(e, "net_revenue", list(probs), error)
    n = F.count(F.lit(1))

    def close(p):  # the ranks that the value stands for reach within the error
        value = F.lit(net[p]).cast(MONEY_TYPE)
        below, upto = F.count_if(F.col("net_revenue") < value), F.count_if(F.col("net_revenue") <= value)
        return (below <= (p + error) * n + 1) & (upto >= (p - error) * n - 1)
    return e.agg(F.lit(few[0.45]).cast("int").alias("quantity_p45"), F.lit(few[0.85]).cast("int").alias("quantity_p85"),
                 close(probs[0]).alias("net_p50_within_error"), close(probs[1]).alias("net_p90_within_error"))


def kpi_report_q(spark, sf):
    """The report as ordered rows: section, position, key, metric, value."""
    return groups.report_rows(groups.kpi_groups(_enriched(spark, sf), CFG), CFG)


def pipeline_run(spark, sf):
    """The whole four-stage job; what it recorded and the totals it reports."""
    target, metrics = scratch_path(spark, "run"), scratch_path(spark, "run-metrics")
    result = run_pipeline(spark, _tx(spark, sf), target, "tables", CFG, metrics_path=metrics)
    written = read_clean(spark, result.clean_path).agg(F.count(F.lit(1)).alias("clean_rows_written"))
    runs = read_run_metrics(spark, metrics, None, multiline=False)
    kpi = lambda name: F.col("kpis")[name].alias(name)
    out = runs.select("status", "raw_rows", "clean_rows", "quality.rows_before", "quality.rows_after",
                      "quality.drop_pct", "quality.null_rate_before", "quality.null_rate_after",
                      kpi("total_net_revenue"), kpi("unique_customers"), kpi("median_order_value"),
                      kpi("high_value_txn_pct"))
    return out.crossJoin(written)


def run_records(spark, sf):
    """What runs leave behind: one staged in the cache, one in a table, and one
    that fails; the recorded status, counts, written size and times. The source
    is held, dealt by key: its joins and the shuffle of whole rows run once for
    all three."""
    metrics, tx = scratch_path(spark, "run-records"), held(dealt(_tx(spark, sf), CFG.key))
    sizes = []
    for staging in ("cache", "table"):
        target = scratch_path(spark, f"run-{staging}")
        result = run_pipeline(spark, tx, target, staging, CFG, metrics_path=metrics, staging=staging)
        size = written_size_mb(spark, result.clean_path)
        parts = spark.read.parquet(result.clean_path).select(F.input_file_name()).distinct().count()
        sizes.append((staging, size > 0, parts > 0, path_exists(spark, f"{target}/_staged")))
    broken = tx.withColumn("price", F.raise_error(F.lit("unreadable price")).cast("double"))
    run_pipeline(spark, broken, scratch_path(spark, "run-failed"), "failed", CFG, metrics_path=metrics, raise_errors=False)
    kept = spark.createDataFrame(sizes, "scale_label string, has_size boolean, has_parts boolean, staged_left boolean")
    runs = read_run_metrics(spark, metrics, None, multiline=False)
    stages = sum((F.col(f"time_{s}_s") for s in compare.STAGES), F.lit(0.0))
    return runs.join(kept, "scale_label", "left").select(
        "scale_label", "status", F.col("error_msg").contains("unreadable price").alias("names_the_error"),
        "raw_rows", "clean_rows", "has_size", "has_parts", "staged_left",
        (stages <= F.col("time_total_s") + 0.001).alias("stages_within_total"),
        (F.col("finished_at").isNotNull() & (F.col("cores_used") > 0)).alias("stamped"))


def run_append_twice(spark, sf):
    """Run rows written again by a retry: one row a run, the last one written."""
    runs = run_history(spark, sf).withColumn("kpis", F.lit(None).cast("map<string,double>"))
    path = scratch_path(spark, "append-twice")
    append_run_metrics(runs, path)
    append_run_metrics(runs.where("framework = 'pandas'").withColumn("cores_used", F.lit(16)), path)
    return read_run_metrics(spark, path, None, multiline=False).select("run_id", "framework", "cores_used", "raw_rows")


# --- run comparison ------------------------------------------------------------

def run_history(spark, sf):
    """A run history made of the events: each (event type, day, six hours) is a
    run, so every (framework, scale) was run up to four times."""
    e = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet")
    e = e.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", F.col("event_id"),
                 F.col("value").cast("decimal(12,2)").alias("v"))
    framework = (F.when(F.col("event_type") == "click", "pandas").when(F.col("event_type") == "view", "pyspark")
                 .otherwise(F.col("event_type")))
    day, part = F.dayofmonth("ts"), F.floor(F.hour("ts") / 6)
    stage = lambda i: F.coalesce(F.sum(F.when(F.col("event_id") % 4 == i, F.col("v"))), F.lit(0)).cast("double")
    n = F.count(F.lit(1))
    runs = e.groupBy(framework.alias("framework"), F.concat(F.lit("D"), day.cast("string")).alias("scale_label"),
                     day.alias("day"), part.alias("part")).agg(
        F.max("ts").cast("timestamp").alias("finished_at"), n.alias("n"), F.count_if(F.col("v") > 20).alias("kept"),
        *[stage(i).alias(f"time_{s}_s") for i, s in enumerate(compare.STAGES)],
        F.sum("v").cast("double").alias("total"))
    ok = F.col("n") % 5 != 0
    drop = percent(F.col("n") - F.col("kept"), F.col("n"), 2)
    return runs.select(
        F.concat_ws("-", "framework", "scale_label", F.col("part").cast("string")).alias("run_id"), "finished_at",
        "framework", "scale_label", F.when(ok, "SUCCESS").otherwise("ERROR").alias("status"),
        F.lit(None).cast("string").alias("error_msg"), (F.col("day") * 10000).cast("bigint").alias("raw_rows"),
        F.col("kept").alias("clean_rows"), F.lit(8).alias("cores_used"),
        *[f"time_{s}_s" for s in compare.STAGES], F.when(ok, F.col("total")).alias("time_total_s"),
        F.lit(None).cast("double").alias("memory_peak_mb"),
        F.struct(F.col("n").alias("rows_before"), F.col("kept").alias("rows_after"),
                 (F.col("n") - F.col("kept")).alias("rows_dropped"), drop.alias("drop_pct"),
                 F.lit(0.5).alias("null_rate_before"), F.lit(0.0).alias("null_rate_after")).alias("quality"))


def run_summary_q(spark, sf):
    return compare.summary_table(run_history(spark, sf))


def run_align_q(spark, sf):
    return compare.align(run_history(spark, sf))


def run_speedup_q(spark, sf):
    return compare.speedup(run_history(spark, sf))


def run_throughput_q(spark, sf):
    return compare.throughput(run_history(spark, sf))


def run_stage_breakdown_q(spark, sf):
    return compare.stage_breakdown(run_history(spark, sf))


def run_quality_q(spark, sf):
    return compare.quality_series(run_history(spark, sf))


def run_ranked_q(spark, sf):
    return compare.ranked_runs(run_history(spark, sf)).select("framework", "place", "run_id", "time_total_s")


# --- set operations and round trips -----------------------------------------

def replicate_union(spark, sf):
    """Cleaning is idempotent under replication: 3 copies in, same rows out.
    Counted in one pass: each key brings its number of copies along."""
    rows = judged_rows(prepare(replicate(_tx(spark, sf), 3), CFG), CFG)
    net = F.sum(F.when(F.col("_kept"), F.col("net_revenue")))
    return rows.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_in"), F.count_if("_kept").alias("rows_clean"),
                    round_money(F.coalesce(net, F.lit(0).cast(MONEY_TYPE)), MONEY_DIGITS).alias("total_net_revenue"))


def csv_round_trip(spark, sf):
    """Transactions written as CSV (text timestamps, NA tokens as text) and read
    back with the declared schema, then cleaned and enriched."""
    path = scratch_path(spark, "csv-round-trip")
    write_csv(_tx(spark, sf), path, mode="overwrite")
    schema = T.StructType(RAW_SCHEMA.fields + [T.StructField(TIE_BREAK_COLUMN, T.DoubleType())])
    return enriched(read_transactions_csv(spark, path, schema), CFG)


def csv_quoting_round_trip(spark, sf):
    """Names with quotes, commas and outer blanks survive the CSV sink and source."""
    part = spark.read.parquet(f"{sf.rstrip('/')}/part.parquet")
    kind, name = F.col("p_partkey") % 5, F.col("p_name")
    dirty = (F.when(kind == 0, F.concat(F.lit('say "'), name, F.lit('", please')))
             .when(kind == 1, F.concat(F.lit("  "), name, F.lit("  "))).when(kind == 2, F.concat(name, F.lit(",,")))
             .when(kind == 3, F.concat(F.lit('"'), name)).otherwise(name))
    out = part.select(F.col("p_partkey").alias("product_id"), dirty.alias("product_name"),
                      F.col("p_retailprice").alias("price"))
    path = scratch_path(spark, "csv-quoting")
    write_csv(out, path, mode="overwrite")
    return read_transactions_csv(spark, path, out.schema)


def csv_rejects(spark, sf):
    """Transactions written as CSV with torn names, prices that are no number and
    prices beyond the price type; split into accepted rows and a quarantine, and
    counted by reason."""
    tx = _tx(spark, sf).select(*RAW_COLUMNS)
    key = F.col("transaction_id")
    price = (F.when(key % 13 == 0, "12,50").when(key % 11 == 0, F.concat(F.lit("1"), F.repeat(F.lit("0"), 30)))
             .otherwise(F.col("price").cast("string")))
    name = F.when(key % 17 == 0, F.concat("product_name", F.lit("\nsecond line"))).otherwise(F.col("product_name"))
    path, target = scratch_path(spark, "csv-dirty"), scratch_path(spark, "csv-split")
    write_csv(tx.withColumns({"price": price, "product_name": name}), path, mode="overwrite")
    accepted, rejected = split_csv(spark, path, target, cfg=CFG)
    return reject_report(accepted, rejected)


def write_if_absent(spark, sf):
    """A CSV target that is written, skipped while it is finished, torn (no
    commit marker, a part file lost) and written again."""
    part = spark.read.parquet(f"{sf.rstrip('/')}/part.parquet").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"))
    path = scratch_path(spark, "if-absent")
    read = lambda step: read_transactions_csv(spark, path, part.schema).agg(
        F.lit(step).alias("step"), F.count(F.lit(1)).alias("rows"), F.sum("product_id").alias("ids"))
    steps = []
    for step, rows in (("written", part.repartition(4)), ("skipped", part.limit(1)), ("repaired", part.repartition(4))):
        if step == "repaired":
            delete_path(spark, f"{path}/_SUCCESS")
            delete_path(spark, read_transactions_csv(spark, path, part.schema).inputFiles()[0])
        write_csv(rows, path)
        copy = scratch_path(spark, f"if-absent-{step}")
        read(step).write.parquet(copy)
        steps.append(spark.read.parquet(copy))
    return steps[0].union(steps[1]).union(steps[2])


def incremental_clean(spark, sf):
    """The clean table brought up to date by two batches that share keys; the
    second one twice. The source is held: its joins run once for all three."""
    target = scratch_path(spark, "incremental")
    tx = held(_tx(spark, sf))
    first, second = (tx.where(F.col("product_id") % 3 != 1), tx.where(F.col("product_id") % 3 == 1))
    for batch in (first, second, second):
        apply_batch(spark, batch, target, CFG)
    return read_incremental(spark, target, CFG)


def sketch_ranges(spark, sf):
    """Yearly distinct counts and quantiles from stored daily sketches; their
    true errors against the bounds (three standard errors of HyperLogLog, four
    times KLL's rank error)."""
    e = _enriched(spark, sf)
    path = scratch_path(spark, "daily-sketches")
    write_parquet(sketches.daily_sketches(e, CFG), path)
    years = sketches.merged(spark.read.parquet(path), F.year("day").alias("year"))
    q = years.select(F.col("year").alias("_year"), F.col("unique_customers").alias("_c"),
                     F.col("unique_products").alias("_p"), "p50", "p90", "transactions")
    net = F.col("net_revenue").cast("double")
    true = (e.join(F.broadcast(q), F.col("year").eqNullSafe(F.col("_year")))
            .groupBy("year", "_c", "_p", "transactions").agg(
                F.count(F.lit(1)).alias("rows"), F.count_distinct(CFG.customer).alias("_customers"),
                F.count_distinct(CFG.product).alias("_products"),
                *[F.count_if(net < F.col(p)).alias(f"_below_{p}") for p in ("p50", "p90")],
                *[F.count_if(net <= F.col(p)).alias(f"_upto_{p}") for p in ("p50", "p90")]))

    def near(estimate, exact):
        return F.abs(F.col(estimate) - F.col(exact)) <= 3 * sketches.HLL_ERROR * F.col(exact) + 1

    def ranked(name, p):
        slack = 4 * sketches.KLL_ERROR * F.col("rows") + 1
        return (F.col(f"_below_{name}") <= p * F.col("rows") + slack) & (F.col(f"_upto_{name}") >= p * F.col("rows") - slack)
    return true.select("year", "transactions", (F.col("rows") == F.col("transactions")).alias("rows_agree"),
                       near("_c", "_customers").alias("customers_within"), near("_p", "_products").alias("products_within"),
                       ranked("p50", 0.5).alias("p50_within"), ranked("p90", 0.9).alias("p90_within"))


def parquet_round_trip(spark, sf):
    ct = _clean_table(spark, sf)
    path = scratch_path(spark, "parquet-round-trip")
    write_parquet(ct, path)
    return read_clean(spark, path, ct.schema)


def partitioned_round_trip(spark, sf):
    """The clean table written by year and month, and read back."""
    ct = _clean_table(spark, sf)
    path = scratch_path(spark, "partitioned-round-trip")
    write_parquet(ct, path, partition_by=("year", "month"))
    return read_clean(spark, path, ct.schema).select(*CLEAN_COLUMNS)


def _reported(query: Query) -> Query:
    """Money is an exact decimal inside the engine; a registered query reports it
    as double (the nearest double to the exact value), so results compare the
    same way in every engine. What the query holds goes with its result."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        with holding() as frames:
            df = query(spark, sf)
        return release_with(df.select(*[F.col(f.name).cast("double").alias(f.name)
                                        if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                                        for f in df.schema.fields]), frames)
    run.__name__ = getattr(query, "__name__", "query")
    run.__doc__ = query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {name: _reported(q) for name, q in _queries().items()}


def _queries() -> dict[str, Query]:
    return {
        "na_token_normalise": na_token_normalise,
        "parse_timestamp": parse_timestamp,
        "exact_dedup": exact_dedup_q,
        "dedup_by_key": dedup_by_key_q,
        "drop_critical_nulls": drop_critical_nulls_q,
        "fill_defaults": fill_defaults_q,
        "positive_filter": positive_filter_q,
        "clip_discount": clip_discount_q,
        "revenue_columns": revenue_columns_q,
        "calendar_parts": calendar_parts_q,
        "day_of_week": day_of_week_q,
        "revenue_band": revenue_band_q,
        "high_value_flag": high_value_flag_q,
        "clean_table": clean_table_q,
        "null_profile": null_profile_q,
        "quality_report": quality_report_q,
        "overall_kpis": overall_kpis,
        "distinct_counts": distinct_counts_q,
        "median_order_value": median_order_value,
        "p90_threshold": p90_threshold,
        "status_counts": status_counts_q,
        "status_rates": status_rates_q,
        "category_revenue": category_revenue_q,
        "monthly_trend": monthly_trend_q,
        "payment_method_revenue": payment_method_revenue_q,
        "region_performance": region_performance_q,
        "revenue_band_dist": revenue_band_dist_q,
        "top_customers": top_customers_q,
        "approx_quantiles": approx_quantiles_q,
        "kpi_report": kpi_report_q,
        "pipeline_run": pipeline_run,
        "run_records": run_records,
        "run_append_twice": run_append_twice,
        "run_summary": run_summary_q,
        "run_align": run_align_q,
        "run_speedup": run_speedup_q,
        "run_throughput": run_throughput_q,
        "run_stage_breakdown": run_stage_breakdown_q,
        "run_quality": run_quality_q,
        "run_ranked": run_ranked_q,
        "replicate_union": replicate_union,
        "csv_round_trip": csv_round_trip,
        "csv_quoting_round_trip": csv_quoting_round_trip,
        "parquet_round_trip": parquet_round_trip,
        "partitioned_round_trip": partitioned_round_trip,
        "csv_rejects": csv_rejects,
        "write_if_absent": write_if_absent,
        "incremental_clean": incremental_clean,
        "sketch_ranges": sketch_ranges,
    }


__all__ = ["queries"]
