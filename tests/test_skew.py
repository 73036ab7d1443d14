"""Hot keys: one key (or the null key) holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kassa.config import DEFAULT
from kassa.operators import kpis
from kassa.operators.clean import clean, dedup
from kassa.operators.dedup import exact_dedup
from kassa.operators.normalize import prepare
from kassa.plans.stages import enriched
from kassa.sources.generate import generate_transactions


def _skewed(spark, rows: int = 3000):
    """A third of the rows share transaction id 7, another third have no id."""
    base = generate_transactions(spark, rows, partitions=6)
    third = F.col("transaction_id") % 3
    return base.withColumn(
        "transaction_id",
        F.when(third == 0, F.lit(7)).when(third == 1, F.lit(None)).otherwise(F.col("transaction_id")))


def test_hot_key_dedup_keeps_the_earliest_row(spark):
    raw = prepare(_skewed(spark), DEFAULT)
    out = dedup(raw, DEFAULT)
    assert out.where(F.col("transaction_id") == 7).count() == 1
    assert out.where(F.col("transaction_id").isNull()).count() == 1
    hot = raw.where(F.col("transaction_id") == 7)
    earliest = hot.orderBy(F.col("timestamp").asc_nulls_first(), *[
        F.col(c).asc_nulls_first() for c in hot.columns if c not in ("transaction_id", "timestamp")
    ]).first()
    assert tuple(out.where(F.col("transaction_id") == 7).first()) == tuple(earliest)
    # other keys untouched; null keys never reach the clean table
    assert out.count() == 1000 + 2
    assert clean(raw, DEFAULT).where(F.col("transaction_id").isNull()).count() == 0


def test_hot_group_aggregates_are_exact(spark):
    df = generate_transactions(spark, 6000, partitions=6)
    hot = df.withColumn("category", F.when(F.col("transaction_id") % 3 == 0, "Hot")
                        .otherwise(F.col("category"))) \
            .withColumn("customer_id", F.when(F.col("transaction_id") % 3 == 0, F.lit(1234))
                        .otherwise(F.col("customer_id")))
    e = enriched(hot, DEFAULT)
    cats = {r["category"]: r["transactions"] for r in kpis.category_revenue(e).collect()}
    assert cats["Hot"] == 2000 and sum(cats.values()) == 6000
    top = kpis.top_customers(e).first()
    assert top["customer_id"] == 1234
    total = e.agg(F.sum("net_revenue")).first()[0]
    assert abs(sum(r["net_revenue"] for r in kpis.category_revenue(e).collect())
               - float(total)) <= 0.005 * len(cats) + 1e-6


def test_exact_dedup_of_a_hot_duplicate(spark):
    df = generate_transactions(spark, 900)
    copies = df.unionByName(df.where("transaction_id < 300")).unionByName(
        df.where("transaction_id < 300"))
    assert exact_dedup(copies).count() == 900
