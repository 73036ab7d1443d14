"""Synthetic transactions at any scale, generated by Spark itself.

Every draw is a pure function of ``(seed, transaction_id, column)``: a 64-bit
``xxhash64`` turned into a uniform in ``[0, 1)``, then shaped by an inverse
transform (exponential price, uniform integers, Bernoulli masks, choices from
fixed lists). So the table is identical for any number of partitions or
executors, timestamps included, and a range of ids can be generated on its
own (``start_id``) without generating what comes before it.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kassa.config import (CATEGORIES, CUSTOMER_ID_RANGE, DEVICE_TYPES, DISCOUNT_RANGE,
                          DISCOUNT_SHARE, DUPLICATE_FLAG_SHARE, MISSING_NAME_SHARE,
                          PAYMENT_METHODS, PRICE_EXP_SCALE, PRICE_OFFSET, PRODUCT_ID_RANGE,
                          QUANTITY_RANGE, REGIONS, SCALES, STATUSES, TIMESTAMP_FORMAT,
                          TIMESTAMP_RANGE)
from kassa.schema import RAW_COLUMNS
from kassa.sinks.files import write_csv

_MASK53 = (1 << 53) - 1

# Product names: a pool of 500 title-cased two-word phrases, built from a
# rule (every descriptor with every item) instead of a stored list.
_DESCRIPTORS = ("smart", "compact", "classic", "premium", "eco", "portable", "deluxe",
                "modern", "rugged", "wireless", "organic", "vintage", "ultra", "daily",
                "pro", "mini", "hybrid", "urban", "family", "travel")
_ITEMS = ("lamp", "kettle", "backpack", "speaker", "blender", "jacket", "novel", "helmet",
          "puzzle", "serum", "charger", "mug", "racket", "tent", "monitor", "scarf",
          "cooker", "drone", "notebook", "sneaker", "vacuum", "watch", "candle", "mixer",
          "pillow")


def _epoch_seconds(text: str) -> int:
    """Seconds since the epoch of a naive ``yyyy-MM-dd HH:mm:ss`` text."""
    return int(datetime.strptime(text, "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone.utc)
               .timestamp())


def product_name_pool() -> list[str]:
    return [f"{d} {i}".title() for d in _DESCRIPTORS for i in _ITEMS]


def uniform(seed: int, salt: int, key: str = "transaction_id") -> Column:
    """A uniform draw in [0, 1) from the key, the seed and a per-column salt."""
    h = F.xxhash64(F.col(key), F.lit(seed), F.lit(salt))
    return h.bitwiseAND(F.lit(_MASK53)).cast("double") / float(1 << 53)


def _int_between(u: Column, lo: int, hi: int) -> Column:
    return (F.lit(lo) + F.floor(u * (hi - lo + 1))).cast("long")


def _choice(u: Column, values) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(u * len(values)) + 1).cast("int"))


def generate_transactions(spark: SparkSession, rows: int, start_id: int = 0,
                          seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``rows`` raw transactions with ids ``start_id .. start_id + rows - 1``,
    in the raw schema (timestamps as text, second precision)."""
    ids = spark.range(start_id, start_id + rows, numPartitions=partitions)
    df = ids.select(F.col("id").alias("transaction_id"))
    u = lambda salt: uniform(seed, salt)
    start, end = TIMESTAMP_RANGE
    span = _epoch_seconds(end) - _epoch_seconds(start)
    ts = F.timestamp_add("SECOND", F.floor(u(12) * span).cast("long"),
                         F.lit(start).cast("timestamp_ntz"))
    lo_d, hi_d = DISCOUNT_RANGE
    discount = F.when(u(7) < DISCOUNT_SHARE, F.round(F.lit(lo_d) + u(8) * (hi_d - lo_d), 2)) \
                .otherwise(F.lit(0.0))
    name = F.when(u(5) < MISSING_NAME_SHARE, F.lit("None")) \
            .otherwise(_choice(u(4), product_name_pool()))
    return df.select(
        "transaction_id",
        _int_between(u(1), *CUSTOMER_ID_RANGE).alias("customer_id"),
        _int_between(u(2), *PRODUCT_ID_RANGE).alias("product_id"),
        name.alias("product_name"),
        _choice(u(3), CATEGORIES).alias("category"),
        F.round(-F.log1p(-u(6)) * PRICE_EXP_SCALE + PRICE_OFFSET, 2).alias("price"),
        _int_between(u(9), *QUANTITY_RANGE).cast("int").alias("quantity"),
        discount.alias("discount"),
        _choice(u(10), PAYMENT_METHODS).alias("payment_method"),
        _choice(u(11), STATUSES).alias("status"),
        _choice(u(13), REGIONS).alias("region"),
        _choice(u(14), DEVICE_TYPES).alias("device_type"),
        F.date_format(ts, TIMESTAMP_FORMAT).alias("timestamp"),
        (u(15) < DUPLICATE_FLAG_SHARE).alias("is_duplicate_flag"),
    ).select(*RAW_COLUMNS)


def generate_dataset(spark: SparkSession, scale: str, out_dir: str, seed: int = 42,
                     partitions: int | None = None) -> str:
    """Write one named scale as CSV under ``out_dir`` (left alone if present)."""
    rows, label = SCALES[scale]
    path = f"{out_dir.rstrip('/')}/transactions_{label}"
    write_csv(generate_transactions(spark, rows, seed=seed, partitions=partitions), path,
              mode="ignore")
    return path


def generate_all(spark: SparkSession, out_dir: str, seed: int = 42) -> dict[str, str]:
    return {scale: generate_dataset(spark, scale, out_dir, seed) for scale in SCALES}
