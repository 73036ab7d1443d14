"""The corpus pipeline: documents in, encoded documents out.

Each stage is one of the operators of ``kassa.llm`` with production parameters.
A stage gets the Parquet that the stage before wrote, works on all of it, and
(but for the last) returns the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kassa.llm import decontaminate, jaccard, pieces, quality, surrogates
from kassa.session import scratch_path

#: SQL cannot learn the quality rules or encode pieces; tests/llm holds the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the rules learned from the labels."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id."""
    return jaccard.one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others lose their hit words."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _recounted(decontaminate.remove_spans(docs, items))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by surrogates."""
    return _recounted(surrogates.replace_pii(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_ids, round_trip."""
    import public_tokenizers

    return pieces.encode(docs.drop("n_chars"), public_tokenizers.path("piece_bpe_32k.model"))


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
