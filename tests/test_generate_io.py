"""Generator determinism and domains; CSV/Parquet/JSON round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from kassa.config import CATEGORIES, DEFAULT, PAYMENT_METHODS
from kassa.operators.normalize import prepare
from kassa.plans.stages import enriched
from kassa.schema import RAW_COLUMNS
from kassa.session import scratch_path
from kassa.sinks.files import write_csv, write_parquet, written_size_mb
from kassa.sources.csv import read_transactions_csv
from kassa.sources.generate import generate_dataset, generate_transactions


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_same_seed_same_table_any_partitioning(spark):
    a = generate_transactions(spark, 5000, partitions=2)
    b = generate_transactions(spark, 5000, partitions=9)
    assert _rows(a) == _rows(b)
    c = generate_transactions(spark, 5000, seed=7)
    assert _rows(a) != _rows(c)


def test_id_ranges_compose(spark):
    whole = generate_transactions(spark, 30)
    tail = generate_transactions(spark, 10, start_id=20)
    assert _rows(whole.where("transaction_id >= 20")) == _rows(tail)


def test_domains(spark):
    df = generate_transactions(spark, 20000)
    s = df.agg(F.min("customer_id"), F.max("customer_id"), F.min("product_id"),
               F.max("product_id"), F.min("quantity"), F.max("quantity"), F.min("price"),
               F.max("discount"), F.avg((F.col("discount") > 0).cast("int")),
               F.avg((F.col("product_name") == "None").cast("int")),
               F.min("timestamp"), F.max("timestamp")).first()
    assert 1000 <= s[0] and s[1] <= 99998 and 100 <= s[2] and s[3] <= 9998
    assert (s[4], s[5]) == (1, 10) and s[6] >= 5.0 and s[7] <= 0.40
    assert 0.27 < s[8] < 0.33 and 0.01 < s[9] < 0.03
    assert s[10] >= "2022-01-01" and s[11] < "2024-12-31"
    assert {r[0] for r in df.select("category").distinct().collect()} <= set(CATEGORIES)
    assert {r[0] for r in df.select("payment_method").distinct().collect()} <= set(PAYMENT_METHODS)
    assert df.columns == list(RAW_COLUMNS)


def test_csv_round_trip_and_cleaning(spark):
    path = generate_dataset(spark, "small", scratch_path(spark, "gen"))
    back = read_transactions_csv(spark, path)
    assert back.count() == 10_000
    assert _rows(back) == _rows(generate_transactions(spark, 10_000).select(
        *[F.col(c).cast(back.schema[c].dataType) for c in RAW_COLUMNS]))
    # "None" names are missing values; nothing else is dropped: ids are unique
    prepped = prepare(back, DEFAULT)
    assert prepped.where(F.col("product_name").isNull()).count() > 0
    assert enriched(back, DEFAULT).count() == 10_000
    # skip if present: a second write leaves the files alone
    before = written_size_mb(spark, path, "*.csv")
    write_csv(generate_transactions(spark, 10, seed=1), path, mode="ignore")
    assert written_size_mb(spark, path, "*.csv") == before


def test_parquet_sink_partitioned(spark):
    df = enriched(generate_transactions(spark, 2000), DEFAULT)
    path = scratch_path(spark, "pq")
    write_parquet(df, path, partition_by=("year", "month"))
    back = spark.read.parquet(path)
    assert back.count() == df.count()
    assert written_size_mb(spark, path) > 0
    # partition pruning: a month filter reads only that folder
    plan = back.where("year = 2023 AND month = 5")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
