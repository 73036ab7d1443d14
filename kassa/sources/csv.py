"""CSV transactions: header, declared schema, no inference. Either permissive
(what does not parse becomes null) or split into accepted rows and a quarantine
of the lines that do not fit, with the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kassa.config import CSV_DIALECT, DEFAULT, PRICE_LIMIT, RATE_DIGITS, CleanConfig
from kassa.functions import percent
from kassa.schema import RAW_SCHEMA


CORRUPT = "_corrupt_record"


def read_transactions_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA,
                          multi_line: bool = False, corrupt: bool = False) -> DataFrame:
    """Read CSV file(s) with the declared schema.

    A field that does not parse as its type becomes null (PERMISSIVE), the
    other fields of the row are kept. The empty string is null; the other
    missing-value tokens are mapped by ``operators.normalize_na_tokens``
    (Spark's reader has a single ``nullValue``).

    ``multi_line`` reads line ends inside quoted fields; a file is then read by
    one task, so it is off by default. ``corrupt`` adds the text of a row that
    did not fit the schema as ``_corrupt_record`` (null for a sound row).
    """
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read
            .schema(schema)
            .options(**CSV_DIALECT)
            .option("mode", "PERMISSIVE")
            .option("enforceSchema", True)
            .option("multiLine", multi_line)
            .option("columnNameOfCorruptRecord", CORRUPT)
            .csv(path))


def corrupt_rows(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA,
                 multi_line: bool = False) -> DataFrame:
    """One row: how many rows there are and how many did not fit the schema."""
    rows = read_transactions_csv(spark, path, schema, multi_line, corrupt=True)
    # Whether a row is sound is known only when all of its columns are parsed.
    whole = F.concat_ws("", *[F.col(f.name).cast("string") for f in schema.fields])
    broken = F.when(F.col(CORRUPT).isNotNull(), whole)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count(broken).alias("corrupt_rows"))


def _reason(schema: T.StructType, cfg: CleanConfig) -> Column:
    """Why a row of text fields does not fit the schema; null if it does. A
    field that holds a missing-value token is missing, not wrong."""
    reason = F.when(F.col(CORRUPT).isNotNull(), "columns")
    for f in schema.fields:
        if isinstance(f.dataType, T.StringType):
            continue
        text = F.col(f.name)
        given = text.isNotNull() & ~text.isin(list(cfg.na_tokens))
        reason = reason.when(given & text.try_cast(f.dataType).isNull(), f"type {f.name}")
    if cfg.price in schema.names:
        price = F.col(cfg.price).try_cast("double")
        reason = reason.when(~F.col(cfg.price).isin(list(cfg.na_tokens)) & ~(F.abs(price) < PRICE_LIMIT),
                             f"range {cfg.price}")
    return reason


def split_csv(spark: SparkSession, path: str, target: str, schema: T.StructType = RAW_SCHEMA,
              cfg: CleanConfig = DEFAULT, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """CSV file(s) read once and written under ``target`` as two tables: the
    accepted rows with the declared types, and the quarantine (``line, file,
    reason``) of those that do not fit. Returns both, read back.

    ``reason`` is ``columns`` (too few or many fields: a torn quoted line end
    gives one such line for each part), ``type <column>`` (a field that is not
    of the column's type) or ``range <column>`` (a price that the price type
    does not hold, or that is not finite). The line of a ``columns`` reject is
    the text as read; of the others it is written again from its fields.
    """
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields],
                         T.StructField(CORRUPT, T.StringType())])
    rows = (spark.read.schema(text).options(**CSV_DIALECT).option("mode", "PERMISSIVE")
            .option("enforceSchema", True).option("multiLine", multi_line)
            .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    line = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*schema.names), {"quote": '"', "escape": '"'}))
    judged = rows.select("*", F.col("_metadata.file_path").alias("_file"), _reason(schema, cfg).alias("_reason"))
    bad = F.col("_reason").isNotNull()
    fields = [F.when(~bad, F.col(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name).try_cast(f.dataType))
              .alias(f.name) for f in schema.fields]
    both = judged.select(*fields, F.when(bad, line).alias("_line"), F.when(bad, F.col("_file")).alias("_file"),
                         "_reason", bad.alias("_rejected"))
    both.write.mode("overwrite").partitionBy("_rejected").parquet(target)
    stored = T.StructType([*both.drop("_rejected").schema.fields, T.StructField("_rejected", T.BooleanType())])
    back = spark.read.schema(stored).parquet(target)
    accepted = back.where(~F.col("_rejected")).select(*schema.names)
    rejected = back.where("_rejected").select(F.col("_line").alias("line"), F.col("_file").alias("file"),
                                              F.col("_reason").alias("reason"))
    return accepted, rejected


def reject_report(accepted: DataFrame, rejected: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """The quality report's view of a split: a row for each reason, and one for
    the accepted rows (reason null): ``rows`` and their share in percent."""
    counts = (accepted.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(None).cast("string").alias("reason"), "rows")
              .union(rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).select("reason", "rows")))
    whole = counts.agg(F.sum("rows").alias("_all"))                 # one row
    return counts.crossJoin(F.broadcast(whole)).select(
        "reason", "rows", percent("rows", "_all", RATE_DIGITS).alias("pct"), *extra)
