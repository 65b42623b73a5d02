"""One load: files of a format become stored tables and a description of them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegraph.operators.catalog import CATALOG_SCHEMAS, commit, sweep, table_id, write_catalog, write_table
from tablegraph.operators.links import dedupe_links
from tablegraph.sources.readers import read_dataset

TABLE_SCHEMA = "session_id string, name string, row_count bigint, parquet_path string"
COLUMN_SCHEMA = "session_id string, table string, position int, name string, inferred_type string, stored_type string"


@dataclass(frozen=True)
class StoredLoad:
    """Tables whose rows are written and which are ready to be recorded."""

    session_id: str
    #: Name, row count and path of each table.
    tables: list[tuple[str, int, str | None]]
    columns: dict[str, list[tuple[str, str]]]
    links: DataFrame | None
    #: Spark types of the stored columns of each table.
    types: dict[str, dict[str, str]]


def store(spark: SparkSession, path: str, fmt: str, out: str, session_id: str, load: str | None = None) -> StoredLoad:
    """Read the files below a path and write their rows, those of each load in a place of their own."""
    dataset = read_dataset(spark, path, fmt)
    tables, types = [], {}
    for name, df in dataset.tables.items():
        place = write_table(df, out, session_id, name, load)
        # The stored files know their row counts, so this reads no rows.
        stored = df if place is None else spark.read.parquet(place)
        tables.append((name, stored.count(), place))
        types[name] = dict(df.dtypes)
    return StoredLoad(session_id, tables, dataset.columns, dataset.links, types)


def record(spark: SparkSession, stored: StoredLoad, out: str, load: str) -> None:
    """Write the description of a stored load to the catalog and make it what its session consists of."""
    session = stored.session_id
    own = table_id(F.col("session_id"), F.col("name")).alias("table_id")
    of_table = table_id(F.col("session_id"), F.col("table")).alias("table_id")
    tables = spark.createDataFrame([(session, *table) for table in stored.tables], TABLE_SCHEMA)
    columns = spark.createDataFrame(
        [
            (session, name, position, column, label, stored.types[name].get(column))
            for name, listed in stored.columns.items()
            for position, (column, label) in enumerate(listed)
        ],
        COLUMN_SCHEMA,
    )
    parts = {"tables": tables.coalesce(1).select("*", own), "columns": columns.coalesce(1).select("*", of_table)}
    if stored.links is not None:
        parts["links"] = dedupe_links(stored.links, ["stmt_no", "item_no"]).select(F.lit(session).alias("session_id"), "*")
    for name, df in parts.items():
        fields = [F.col(f"`{field}`") for field in CATALOG_SCHEMAS[name]]
        write_catalog(df.select(*fields, F.lit(load).alias("load")), out, name, "load")
    commit(spark.createDataFrame([(session,)], "session_id string"), out, load)


def ingest(spark: SparkSession, path: str, fmt: str, out: str, session_id: str) -> None:
    """Store the tables found below a path and record them for a session, replacing what it held.

    Rows are written before their description and both before the commit that shows them, so a reader has the old
    load or the new one, whole. What was replaced is then swept away.
    """
    load = f"session-{session_id}-{uuid.uuid4().hex}"
    record(spark, store(spark, path, fmt, out, session_id, load), out, load)
    sweep(spark, out)
