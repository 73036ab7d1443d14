"""Writers."""

from kassa.sinks.files import (append_run_metrics, write_combined_metrics, write_csv,
                               write_parquet, write_report, write_rows, written_size_mb)

__all__ = ["append_run_metrics", "write_combined_metrics", "write_csv", "write_parquet",
           "write_report", "write_rows", "written_size_mb"]
