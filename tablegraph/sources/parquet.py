"""Parquet files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegraph.operators.positions import parquet_with_row_id
from tablegraph.sources.listing import table_files


def read_parquet_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Each Parquet file (or folder of part files) as a table named after it, types kept."""
    return {
        table.name: parquet_with_row_id(spark, table.path)
        for table in table_files(spark, path, "parquet")
    }
