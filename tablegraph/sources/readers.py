"""One entry for every format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegraph.operators.positions import ROW_ID
from tablegraph.operators.profile import STORED_TYPES, typed_labels
from tablegraph.sources.csv import read_csv_tables
from tablegraph.sources.dataset import Dataset
from tablegraph.sources.dump import dump_dataset
from tablegraph.sources.json import json_dataset
from tablegraph.sources.parquet import read_parquet_tables


def _csv_dataset(spark: SparkSession, path: str) -> Dataset:
    tables = read_csv_tables(spark, path, positions=True)
    labels = {stored: label for label, stored in STORED_TYPES.items()}
    columns = {
        name: [(column, labels[kind]) for column, kind in df.dtypes if column != ROW_ID]
        for name, df in tables.items()
    }
    return Dataset(tables, columns)


def _parquet_dataset(spark: SparkSession, path: str) -> Dataset:
    tables = read_parquet_tables(spark, path)
    columns = {}
    for name, df in tables.items():
        labels = typed_labels(df, [column for column in df.columns if column != ROW_ID])
        columns[name] = [(row["name"], row["inferred_type"]) for row in labels.orderBy("position").collect()]
    return Dataset(tables, columns)


READERS = {"csv": _csv_dataset, "json": json_dataset, "sql": dump_dataset, "parquet": _parquet_dataset}


def read_dataset(spark: SparkSession, path: str, fmt: str) -> Dataset:
    """The files of one format below a path as tables with their description."""
    if fmt not in READERS:
        raise ValueError(f"no reader for format {fmt!r}; known: {', '.join(sorted(READERS))}")
    return READERS[fmt](spark, path)


def read_tables(spark: SparkSession, path: str, fmt: str) -> dict[str, DataFrame]:
    """The tables below a path, each with ``_row_id`` in stored order."""
    return read_dataset(spark, path, fmt).tables
