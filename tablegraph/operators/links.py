"""Links between tables, as rows of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegraph.functions.phrases import COLUMN_SEPARATOR, edge_columns

LINK_KEY = ["from_table", "to_table", "from_column", "to_column", "type"]

FORWARD_ARROW = "→"
BACKWARD_ARROW = "←"


def _present(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def usable_links(links: DataFrame) -> DataFrame:
    """Links with one column on each side, which rows can be matched through."""
    condition = F.lit(True)
    for name in ("from_column", "to_column"):
        c = F.col(name)
        condition = condition & _present(c) & ~c.contains(COLUMN_SEPARATOR)
    return links.where(condition)


def dedupe_links(links: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """One link per identity, the first in order kept; empty texts become null.

    ``within`` names columns that keep links apart, such as the session.
    """
    # Null and empty text mean the same "not named", so they must meet.
    within = within or []
    names = [name for name in links.columns if name not in order]
    identity = [*within, *LINK_KEY]
    plain = links.select(
        *[
            F.coalesce(F.col(name), F.lit("")).alias(name)
            if name in ("from_column", "to_column")
            else F.col(name)
            for name in links.columns
        ]
    )
    rest = [name for name in names if name not in identity]
    first = plain.groupBy(*identity).agg(F.min(F.struct(*order, *rest)).alias("first"))
    out = first.select(*identity, *[F.col(f"first.{name}") for name in rest])
    texts = {name for name, kind in out.dtypes if kind == "string"} - {"from_table", "to_table", "type"}
    return out.select(
        *[F.nullif(F.col(n), F.lit("")).alias(n) if n in texts else F.col(n) for n in names]
    )


def schema_edges(tables: DataFrame, links: DataFrame) -> DataFrame:
    """Links with both ends resolved to table ids inside their session.

    A link with an end that the session did not yield is left out; see
    ``dangling_links`` for those.
    """
    ends = tables.select("session_id", F.col("name"), "table_id")
    source = ends.withColumnsRenamed({"name": "from_table", "table_id": "from_table_id"})
    target = ends.withColumnsRenamed({"name": "to_table", "table_id": "to_table_id"})
    return links.join(source, ["session_id", "from_table"]).join(target, ["session_id", "to_table"])


def dangling_links(tables: DataFrame, links: DataFrame) -> DataFrame:
    """Links with a missing end, with which end it is."""
    names = tables.select("session_id", F.col("name"))
    source = names.withColumnRenamed("name", "from_table").withColumn("_source", F.lit(True))
    target = names.withColumnRenamed("name", "to_table").withColumn("_target", F.lit(True))
    joined = links.join(source, ["session_id", "from_table"], "left").join(
        target, ["session_id", "to_table"], "left"
    )
    missing = (
        F.when(F.col("_source").isNull() & F.col("_target").isNull(), "both")
        .when(F.col("_source").isNull(), "from")
        .when(F.col("_target").isNull(), "to")
    )
    return (
        joined.withColumn("missing", missing)
        .where(F.col("missing").isNotNull())
        .select(*links.columns, "missing")
    )


def neighbour_tables(links: DataFrame, tables: DataFrame, table: str | None = None) -> DataFrame:
    """Tables at the other end of usable links, in the same session, never the table itself.

    For one table, or for every table when none is given.
    """
    usable = usable_links(links).where(F.col("from_table") != F.col("to_table"))
    both = F.array(
        F.struct(F.col("from_table").alias("table"), F.col("to_table").alias("neighbour")),
        F.struct(F.col("to_table").alias("table"), F.col("from_table").alias("neighbour")),
    )
    pairs = usable.select("session_id", F.inline(both))
    if table is not None:
        pairs = pairs.where(F.col("table") == table)
    known = tables.select("session_id", F.col("name"))
    return (
        pairs.distinct()
        .join(known.withColumnRenamed("name", "table"), ["session_id", "table"], "left_semi")
        .join(known.withColumnRenamed("name", "neighbour"), ["session_id", "neighbour"], "left_semi")
        .select("session_id", "table", "neighbour")
    )


def directed_links(edges: DataFrame, node: str | None = None) -> DataFrame:
    """Edges of a schema graph read outwards from a node, or from each of its ends.

    The phrase matches the direction: the link's name along it, its inverse
    name against it. A link of a table to itself is read along only.
    """
    columns = edge_columns(F.col("from_column"), F.col("to_column"), F.col("type"))
    along = F.struct(
        F.col("from_table").alias("node"),
        F.lit(FORWARD_ARROW).alias("direction"),
        F.coalesce("name", columns).alias("phrase"),
        F.col("to_table").alias("other"),
        columns.alias("columns"),
    )
    against = F.struct(
        F.col("to_table").alias("node"),
        F.lit(BACKWARD_ARROW).alias("direction"),
        F.coalesce("inverse_name", columns).alias("phrase"),
        F.col("from_table").alias("other"),
        columns.alias("columns"),
    )
    readings = F.when(F.col("from_table") == F.col("to_table"), F.array(along)).otherwise(
        F.array(along, against)
    )
    keep = [F.col("session_id")] if "session_id" in edges.columns else []
    chosen = edges
    if node is not None:
        chosen = edges.where((F.col("from_table") == node) | (F.col("to_table") == node))
    out = chosen.select(*keep, F.inline(readings))
    return out if node is None else out.where(F.col("node") == node)


def directed_row_links(edges: DataFrame, node: str | None = None) -> DataFrame:
    """As ``directed_links`` for a row graph, where both directions show the edge's label."""
    along = F.struct(
        F.col("source").alias("node"), F.lit(FORWARD_ARROW).alias("direction"), "label", F.col("target").alias("other")
    )
    against = F.struct(
        F.col("target").alias("node"), F.lit(BACKWARD_ARROW).alias("direction"), "label", F.col("source").alias("other")
    )
    readings = F.when(F.col("source") == F.col("target"), F.array(along)).otherwise(F.array(along, against))
    out = edges.select(F.inline(readings))
    return out if node is None else out.where(F.col("node") == node)


def closed_neighbourhood(nodes: DataFrame, edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """A node with all nodes one hop away, and the edges touching it.

    Nodes have an ``id``; edges have ``source`` and ``target`` ids.
    """
    near = edges.where((F.col("source") == node) | (F.col("target") == node))
    # Only the far end of each edge: the node itself would be one hot key.
    far = F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source"))
    others = near.select(far.alias("id")).distinct()
    own = F.col("id") == node
    inside = nodes.where(own).unionByName(nodes.where(~own).join(others, "id", "left_semi"))
    return inside, near
