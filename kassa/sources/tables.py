"""Transactions derived from the shared test tables (lineitem, orders, part,
customer, nation, region).

The tables hold no nulls and no duplicates, so the mapping injects
deterministic dirt from the supplier key (every row is kept; the ``%`` rules
choose *values*, not rows). ``transaction_id`` collides naturally across
orders, which exercises the keyed dedup.

Join order is chosen for scale: the small geography (nation x region) joins
customers, customers join orders first (orders is 4x smaller than lineitem),
so lineitem itself is shuffled at most for the part join and the order join.
Broadcasts are left to the planner's size check: a side is broadcast only when
its measured size is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE
re-checks with runtime sizes), otherwise the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kassa.config import CleanConfig

TIE_BREAK_COLUMN = "_tb_extendedprice"

# Deduplication of the derived table: earliest ship time, then the line's
# extended price, then the part; no ties are left at any scale.
TABLES_CONFIG = CleanConfig(tie_breakers=(TIE_BREAK_COLUMN, "product_id"),
                            drop_after_dedup=(TIE_BREAK_COLUMN,))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _every(col: str, n: int):
    return F.col(col) % n == 0


def transactions_from_tables(spark: SparkSession, sf_dir: str,
                             with_tie_breaker: bool = True) -> DataFrame:
    """The 14 transaction columns (plus the tie-break helper, by default)."""
    # Of the supplier and the return flag the rows need six facts: they cross the
    # joins as the bits of one byte.
    facts = (*(_every("l_suppkey", n) for n in (97, 89, 83, 79, 73)), F.col("l_returnflag") == "A")
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_shipdate",
        sum((F.when(fact, 1 << bit).otherwise(0) for bit, fact in enumerate(facts)), F.lit(0))
        .cast("tinyint").alias("l_facts"))
    no_customer, no_category, no_price, less, dearer, returned = (
        F.col("l_facts").bitwiseAND(1 << bit) > 0 for bit in range(len(facts)))
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    cust = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    geo = (_read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
           .join(_read(spark, sf_dir, "region").select("r_regionkey", "r_name"),
                 F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "r_name"))
    # nation x region is tiny; the planner broadcasts it by its measured size
    # (spark.sql.autoBroadcastJoinThreshold), as it does the other sides when
    # they are small, and falls back to a shuffle join when they are not.
    cust_geo = cust.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    orders_c = orders.join(cust_geo, F.col("o_custkey") == F.col("c_custkey"))
    # lineitem meets only a base table (part) or a join result: without
    # column statistics a join result is estimated large, so lineitem is never
    # chosen as a broadcast side; AQE still broadcasts the orders side at
    # runtime when its measured size is small.
    lines = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.join(orders_c, F.col("l_orderkey") == F.col("o_orderkey"))

    status = (F.when(F.col("o_orderstatus") == "F", "completed")
               .when(F.col("o_orderstatus") == "O",
                     F.when(returned, "cancelled").otherwise("pending"))
               .otherwise("refunded"))
    cols = [
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
        F.when(no_customer, F.lit(None)).otherwise(F.col("o_custkey"))
         .cast("long").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.when(_every("l_partkey", 50), F.lit("None")).otherwise(F.col("p_name"))
         .alias("product_name"),
        F.when(no_category, F.lit(None).cast("string")).otherwise(F.col("p_type"))
         .alias("category"),
        F.when(no_price, F.lit(-1.0))
         .otherwise(F.floor(F.col("l_extendedprice") / 10) / 100).alias("price"),
        ((F.col("l_quantity").cast("int") - 1) % 10
         + F.when(less, 0).otherwise(1)).alias("quantity"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
         .otherwise(F.col("l_discount") * F.when(dearer, 20).otherwise(1)
                    + F.lit(0.0)).alias("discount"),
        F.col("o_orderpriority").alias("payment_method"),
        status.alias("status"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("device_type"),
        F.col("l_shipdate").alias("timestamp"),
        F.lit(False).alias("is_duplicate_flag"),
    ]
    if with_tie_breaker:
        cols.append(F.col("l_extendedprice").alias(TIE_BREAK_COLUMN))
    return rows.select(*cols)
