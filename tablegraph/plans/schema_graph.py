"""Tables joined by their declared links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.functions.phrases import edge_label
from tablegraph.operators.links import schema_edges


@dataclass(frozen=True)
class SchemaGraph:
    nodes: DataFrame
    edges: DataFrame


def schema_nodes(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables as nodes with their row and column counts, zero columns included."""
    counts = columns.groupBy("table_id").agg(F.count("*").alias("column_count"))
    return tables.join(counts, "table_id", "left").select(
        "session_id",
        "table_id",
        "name",
        "row_count",
        F.coalesce("column_count", F.lit(0)).cast("bigint").alias("column_count"),
    )


def schema_graph(
    tables: DataFrame, columns: DataFrame, links: DataFrame, session_id=None
) -> SchemaGraph:
    """The schema graph of one session, or of every session when none is given."""
    if session_id is not None:
        own = F.col("session_id") == F.lit(session_id)
        tables, links = tables.where(own), links.where(own)
        columns = columns.join(tables.select("table_id"), "table_id", "left_semi")
    edges = schema_edges(tables, links).withColumn(
        "label",
        edge_label(F.col("name"), F.col("from_column"), F.col("to_column"), F.col("type")),
    )
    return SchemaGraph(schema_nodes(tables, columns), edges)


def graph_summary(nodes: DataFrame, edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Node and edge counts, in one row or per value of the ``by`` columns."""
    by = by or []
    both = nodes.select(*by, F.lit(1).alias("node")).unionByName(
        edges.select(*by, F.lit(0).alias("node"))
    )
    return both.groupBy(*by).agg(
        F.count_if(F.col("node") == 1).alias("n_nodes"), F.count_if(F.col("node") == 0).alias("n_edges")
    )
