"""Readers and generators of transaction tables."""

from kassa.sources.csv import read_transactions_csv
from kassa.sources.generate import generate_all, generate_dataset, generate_transactions
from kassa.sources.metrics import load_run_metrics, read_run_metrics
from kassa.sources.parquet import read_clean
from kassa.sources.tables import TABLES_CONFIG, transactions_from_tables

__all__ = ["TABLES_CONFIG", "generate_all", "generate_dataset", "generate_transactions",
           "load_run_metrics", "read_clean", "read_run_metrics", "read_transactions_csv",
           "transactions_from_tables"]
