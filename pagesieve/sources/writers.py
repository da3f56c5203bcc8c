"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagesieve.operators.report import safe_host


def write_text(results: DataFrame, path: str, by_host: bool = False, rows_per_file: int = 1_000_000) -> None:
    """Results (url, file_name, body) as parquet, many results per file instead of one file each.

    by_host adds a folder per host for readers that take single hosts. Rows are gathered by host
    with a rebalance: Spark cuts the share of a large host into many tasks and puts small hosts
    together, from the sizes it measures.
    """
    out = results.select(safe_host(F.col("url")).alias("host_safe"), "file_name", "body")
    if by_host:
        out = out.hint("rebalance", "host_safe")
    writer = out.write.mode("append").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy("host_safe") if by_host else writer).parquet(path)
