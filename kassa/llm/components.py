"""Connected components of an edge table (large-star / small-star, Kiveris et
al. 2014) as DataFrame rounds.

A round takes minima per node with map-side aggregation and joins them back to
the edges (a hub is a skewed join key, which AQE splits). Each round is written
to the shared folder, so lost executors cost one round at most; rounds grow
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.session import release_scratch, scratch_path


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back (a lineage cut)."""
    return _stored(df, name)[0]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        moved = both.join(least, F.col("u") == F.col("k")).where(F.col("v") > F.col("u"))
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = edges.join(least, F.col("u") == F.col("k"))
        out = (joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))))
    return out.where(F.col("u") != F.col("v")).distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none: stars."""
    down = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    open_ = edges.join(down.select(F.col("u").alias("k")), F.col("v") == F.col("k"), "left_semi")
    return down.where("n > 1").select("u").limit(1).union(open_.select("u").limit(1)).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node of the component) for every node of
    the edges ``a, b``; self loops and nulls are no edges."""
    now, path = _stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), "components")
    while not _is_forest(now):
        last = path
        now, path = _stored(_star(_star(now, large=True), large=False), "components")
        release_scratch(now.sparkSession, [last])       # only this round reads the one before
    roots = now.select(F.col("v").alias("node")).distinct()
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(roots.select("node", F.col("node").alias("component"))))
