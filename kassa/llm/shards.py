"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number for every key, and the key goes to the shard with
the best draw (highest random weight, Thaler and Ravishankar 1998; weighted by
``-ln(u) / weight``, Schindelhauer and Schomaker 2005). The draw depends on the
key and the shard's name alone, so a new shard takes rows from the others into
itself and moves no other row, a removed one gives up its own rows alone, and
a changed weight moves rows to or from that shard alone. On average a shard
holds its share of the weights. The law is ``key``: rows of one key share a
shard; rows with equal texts under other keys need not.

Draws are the first 52 bits of an MD5, as a uniform number; the logarithm is
Java's StrictMath, so every machine gives the same shard.

Slots number the rows of a shard from 0 without a gap, in the order of a hash
of the key: a fixed shuffle of each shard, whatever the partitions were. A
shard may hold any number of rows, so it is never one window: rows are counted
by cells (leading bits of that hash), a cell's first slot is the sum of the
cells before it, and only a cell's rows are ordered together. Rows that are
equal in all that decides the order are counted first, map-side, and dealt
their slots afterwards in bounded runs, so a hot key or a copied row is one
row of the cell.

Scale: choosing a shard is an expression without a shuffle. Slots shuffle
narrow rows (no texts) twice. The cell table, of about ``rows / CELL_ROWS``
rows, is the only thing that one window orders; Spark joins it by its size.

Edge cases: a null key draws like the key ``""`` of a type of its own (it never
equals a text), so null keys share a shard; repeated keys share one too and
have slots of their own; an empty table gives no rows. A column named like a
result column is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS = 8
CELL_ROWS = 100_000
RUN = 1 << 16                              # copies of one row numbered by one task
_BITS = 52


def shard_weights(shards: int | Sequence | Mapping) -> dict:
    """Shard names with their weights: a count (0 .. n-1, equal), names, or a map."""
    if isinstance(shards, int):
        shards = range(shards)
    weights = dict(shards) if isinstance(shards, Mapping) else {s: 1.0 for s in shards}
    weights = {s: float(w) for s, w in weights.items() if w}
    if not weights or min(weights.values()) < 0 or len({str(s) for s in weights}) < len(weights):
        raise ValueError("shards need distinct names and weights of 0 or more, one above 0")
    return weights


def _key(key: Column) -> Column:
    """The key as hashed text: null is apart from every value."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))


def draw(key: Column, shard) -> Column:
    """A shard's uniform draw in (0, 1) for a key."""
    digest = F.md5(F.concat(_key(key), F.lit(f"@{shard}")).cast("binary"))
    bits = F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << _BITS))


def rendezvous(key: Column, shards: int | Sequence | Mapping = SHARDS) -> Column:
    """The shard of a key: the least ``-ln(u) / weight``; on equal draws the
    shard that is named first."""
    costs = [F.struct((-F.log(draw(key, s)) / F.lit(w)).alias("cost"), F.lit(i).alias("at"), F.lit(s).alias("shard"))
             for i, (s, w) in enumerate(shard_weights(shards).items())]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def with_shards(df: DataFrame, key: str, shards: int | Sequence | Mapping = SHARDS,
                column: str = "shard") -> DataFrame:
    """``df`` with the shard of every row; no shuffle."""
    return df.withColumn(column, rendezvous(F.col(key), shards))


def with_slots(rows: DataFrame, key: str, shard: str = "shard", column: str = "slot",
               cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` (narrow) with the place of every row in its shard. Rows are
    ordered by a hash of the key, then by all columns."""
    rows = rows.drop(column)
    names = rows.columns
    n = rows.count()
    # Cells are ranges of the hash's first eight hexadecimal digits.
    bits = min(32, max(0, (n // max(1, cell_rows)).bit_length()))
    hashed = F.md5(F.concat(_key(F.col(key)), F.lit("#")).cast("binary"))
    copies = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).withColumn("_hash", hashed)
    cell = F.shiftrightunsigned(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long"), 32 - bits)
    copies = copies.withColumn("_cell", cell)
    counts = copies.groupBy(F.col(shard).alias("_s"), F.col("_cell").alias("_c")).agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_s", "_c", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = (Window.partitionBy(shard, "_cell").orderBy("_hash", *names)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (copies.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
              .join(starts, F.col(shard).eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
              .withColumn("_first", F.col("_start") + F.col("_before")))
    single = placed.where("_n = 1").select(*names, F.col("_first").alias(column))
    runs = (placed.where("_n > 1")
            .select(*names, "_first", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1,
                                                                  F.lit(RUN).cast("long"))).alias("_run"))
            .repartition("_first", "_run"))
    copied = runs.select(*names, F.explode(F.sequence(
        F.col("_first") + F.col("_run"),
        F.col("_first") + F.least(F.col("_run") + F.lit(RUN), F.col("_n")) - 1)).alias(column))
    return single.union(copied)


def write_shards(df: DataFrame, path: str, key: str, shards: int | Sequence | Mapping = SHARDS,
                 rows_per_file: int = 1_000_000) -> None:
    """Whole rows as one Parquet folder a shard (``shard=...``), in files of at
    most ``rows_per_file`` rows. Rows are dealt over the tasks by shard and a
    hash of the row, so no task holds a shard."""
    spread = max(2, df.sparkSession.sparkContext.defaultParallelism)
    part = with_shards(df, key, shards)
    part = part.withColumn("_deal", F.pmod(F.xxhash64(*[F.col(c) for c, t in df.dtypes if not t.startswith("map")]),
                                           F.lit(spread)))
    (part.hint("rebalance", "shard", "_deal").drop("_deal")
     .write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` dealt over 8 shards by doc_id: doc_id, size, text_crc32,
    law, shard, slot, grown_shard (with 9 shards)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    rows = with_shards(rows, "doc_id", SHARDS)
    rows = with_shards(rows, "doc_id", SHARDS + 1, "grown_shard")
    return with_slots(rows, "doc_id").withColumn("law", F.lit("key"))
