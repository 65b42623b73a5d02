"""Rows joined by matching key values: capped around one table, or complete."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegraph.functions.phrases import edge_label
from tablegraph.functions.text import edge_id, join_key, quoted, row_id, row_label, same_integral
from tablegraph.operators.links import usable_links
from tablegraph.operators.positions import ROW_ID
from tablegraph.operators.profile import union_all

ROOT_DEFAULT = 50
ROOT_MOST = 200
NEIGHBOUR_CAP = 500
EDGE_CAP = 2000
#: The most edges a view may keep; their ends are broadcast. ``full_row_graph`` has no limit.
EDGE_MOST = 100_000

EDGE_ORDER = ["link_ord", "source_pos", "target_pos"]


@dataclass(frozen=True)
class Link:
    """A usable link as plan metadata: its place among the links and its ends."""

    ord: int
    from_table: str
    to_table: str
    from_column: str
    to_column: str
    label: str


@dataclass(frozen=True)
class RowGraph:
    nodes: DataFrame
    edges: DataFrame
    #: One row: whether rows of the root or edges were left out.
    truncated: DataFrame


def plan_links(links: DataFrame, tables: dict[str, DataFrame], root: str | None = None) -> list[Link]:
    """The links a row graph follows, in a fixed order, read from the catalog as metadata.

    Links that cannot be followed are dropped here, before any table is read.
    """
    usable = usable_links(links)
    if root is not None:
        usable = usable.where((F.col("from_table") == root) | (F.col("to_table") == root))
    label = edge_label(
        F.nullif(F.col("name"), F.lit("")), F.col("from_column"), F.col("to_column"), F.col("type")
    )
    rows = (
        usable.select("from_table", "to_table", "from_column", "to_column", label.alias("label"))
        .distinct()
        .orderBy("from_table", "to_table", "from_column", "to_column", "label")
        .collect()
    )
    known = [row for row in rows if row["from_table"] in tables and row["to_table"] in tables]
    return [Link(i, *row) for i, row in enumerate(known)]


def _keyed(df: DataFrame, column: str, key: Column, position: str) -> DataFrame:
    return df.select(key.alias("_key"), F.col(ROW_ID).alias(position)).where(F.col("_key").isNotNull())


def link_keys(src: DataFrame, dst: DataFrame, link: Link) -> tuple[DataFrame, DataFrame]:
    """Both sides of a link as (key, position), rows without a key dropped.

    Integer keys are compared as they are, which keeps scan statistics useful;
    any other pair is compared as normalised text.
    """
    left = src.schema[link.from_column].dataType
    right = dst.schema[link.to_column].dataType
    source, target = quoted(link.from_column), quoted(link.to_column)
    if same_integral(left, right) or (left == right and isinstance(left, T.StringType)):
        keys = (source, target)
    else:
        keys = (join_key(source, left), join_key(target, right))
    return _keyed(src, link.from_column, keys[0], "source_pos"), _keyed(
        dst, link.to_column, keys[1], "target_pos"
    )


#: Rows of one key, on either side, from which the key is dealt over cells.
HOT_ROWS = 1_000_000
#: Rows of either side in a cell of a hot key, on average.
CELL_ROWS = 50_000
#: Keys a sketch reports per side, so what is sent to every task is bounded by twice as many.
SKETCH_KEYS = 200


def hot_keys(
    tables: dict[str, DataFrame], links: list[Link], hot_rows: int = HOT_ROWS
) -> dict[int, list[tuple[str, int, int]]]:
    """Per link its hottest keys as text, with about how many rows of the source and the target hold them.

    A frequent-items sketch per side and link, all in one job; no key is
    shuffled. A key with over a 200th of a side's rows is reported. The counts
    only decide how rows are dealt, so an estimate does no harm.
    """
    sketches = []
    for link in links:
        for side, df in enumerate(link_keys(tables[link.from_table], tables[link.to_table], link)):
            top = df.agg(F.expr(f"approx_top_k(_key, {SKETCH_KEYS}, 8192)").alias("top"))
            sketches.append(
                top.select(F.inline("top").alias("item", "n")).select(
                    F.lit(link.ord).alias("ord"), F.lit(side).alias("side"), F.col("item").cast("string").alias("key"), "n"
                )
            )
    found: dict[int, dict[str, list[int]]] = {}
    if sketches:
        for row in union_all(sketches).where(F.col("key").isNotNull()).collect():
            found.setdefault(row["ord"], {}).setdefault(row["key"], [1, 1])[row["side"]] = row["n"]
    hot = {ord: [(key, *n) for key, n in keys.items() if max(n) >= hot_rows] for ord, keys in found.items()}
    return {ord: keys for ord, keys in hot.items() if keys}


def _dealt(side: DataFrame, cells: DataFrame, position: str, own: str, other: str) -> DataFrame:
    """Rows with the cells they belong to: one part of their own side, all parts of the other."""
    parts = F.coalesce(F.col(f"{own}s"), F.lit(1))
    others = F.coalesce(F.col(f"{other}s"), F.lit(1))
    return side.join(F.broadcast(cells), "_key", "left").select(
        "_key",
        position,
        F.pmod(F.xxhash64(position), parts).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), others - 1)).alias(other),
    )


def row_edges(
    src: DataFrame,
    dst: DataFrame,
    link: Link,
    hot: list[tuple[str, int, int]] | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Every pair of rows the link connects, as positions.

    Only keys and positions are shuffled, and nulls never are. The keys in
    ``hot`` (see ``hot_keys``) are dealt over cells: each side is cut into
    parts of about ``cell_rows``, and every pair of parts is a cell of its own,
    so each pair of rows meets once and a key that holds a third of both
    sides spreads over many tasks. Other keys have one cell.
    """
    source, target = link_keys(src, dst, link)
    on = ["_key"]
    if hot:
        parts = [(key, -(-n_source // cell_rows), -(-n_target // cell_rows)) for key, n_source, n_target in hot]
        cells = src.sparkSession.createDataFrame(parts, "_key string, _sources int, _targets int")
        cells = cells.withColumn("_key", F.col("_key").cast(source.schema["_key"].dataType))
        source = _dealt(source, cells, "source_pos", "_source", "_target")
        target = _dealt(target, cells, "target_pos", "_target", "_source")
        on = ["_key", "_source", "_target"]
    return source.join(target, on).select(
        F.lit(link.ord).alias("link_ord"),
        F.lit(link.from_table).alias("source_table"),
        "source_pos",
        F.lit(link.to_table).alias("target_table"),
        "target_pos",
        F.lit(link.label).alias("label"),
    )


def row_edge_counts(tables: dict[str, DataFrame], links: list[Link]) -> DataFrame:
    """Number of edges per link, without producing them.

    Each side is counted per key first, so a key that matches a third of both
    tables costs two rows instead of its square.
    """
    counts = []
    for link in links:
        source, target = link_keys(tables[link.from_table], tables[link.to_table], link)
        left = source.groupBy("_key").agg(F.count("*").alias("n_source"))
        right = target.groupBy("_key").agg(F.count("*").alias("n_target"))
        pairs = F.col("n_source").cast("decimal(19,0)") * F.col("n_target").cast("decimal(19,0)")
        counts.append(
            left.join(right, "_key")
            .agg(
                F.coalesce(F.sum(pairs), F.lit(0)).cast("bigint").alias("n_edges"),
                F.coalesce(F.sum("n_source"), F.lit(0)).cast("bigint").alias("n_sources"),
                F.count("*").alias("n_keys"),
            )
            .select(
                F.lit(link.from_table).alias("from_table"),
                F.lit(link.to_table).alias("to_table"),
                F.lit(link.from_column).alias("from_column"),
                "n_edges",
                "n_sources",
                "n_keys",
            )
        )
    return union_all(counts)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge per identity (source, target and label), the first link's kept."""
    identity = ["source_table", "source_pos", "target_table", "target_pos", "label"]
    return edges.groupBy(*identity).agg(F.min("link_ord").alias("link_ord")).select(*edges.columns)


def _union_edges(parts: list[tuple[Link, DataFrame]]) -> DataFrame:
    """All edges, each once.

    Two links can only give the same edge when they join the same tables under
    the same label, so only those links are checked for repeats.
    """
    names = Counter((link.from_table, link.to_table, link.label) for link, _ in parts)
    alone = [df for link, df in parts if names[(link.from_table, link.to_table, link.label)] == 1]
    shared = [df for link, df in parts if names[(link.from_table, link.to_table, link.label)] > 1]
    if shared:
        alone.append(distinct_edges(union_all(shared)))
    return union_all(alone)


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Add the text identities of the two rows and of the edge.

    One projection, so that it folds into the top-n step below it.
    """
    source = row_id(F.col("source_table"), F.col("source_pos"))
    target = row_id(F.col("target_table"), F.col("target_pos"))
    return edges.select(
        "*",
        source.alias("source"),
        target.alias("target"),
        edge_id(source, target, F.col("label")).alias("id"),
    )


def cap_edges(edges: DataFrame, cap: int = EDGE_CAP) -> tuple[DataFrame, DataFrame]:
    """The first edges in link, source and target order, and whether there were more.

    Each partition keeps at most ``cap + 1`` edges, so nothing is sorted whole.
    """
    kept = edges.orderBy(*EDGE_ORDER).limit(cap)
    capped = edges.limit(cap + 1).agg((F.count("*") > cap).alias("capped"))
    return kept, capped


def _nodes(df: DataFrame, table: str, content: bool) -> DataFrame:
    names = [name for name in df.columns if name != ROW_ID]
    position = F.col(ROW_ID)
    out = [
        row_id(table, position).alias("id"),
        F.lit(table).alias("table"),
        position.alias("pos"),
        row_label(df, position, names).alias("label"),
    ]
    if content:
        out.append(F.to_json(F.struct(*map(quoted, names))).alias("row"))
    return df.select(*out)


def row_graph(
    tables: dict[str, DataFrame],
    links: DataFrame,
    root: str,
    limit: int = ROOT_DEFAULT,
    neighbour_cap: int | None = None,
    edge_cap: int = EDGE_CAP,
    content: bool = False,
) -> RowGraph:
    """The first rows of one table and the rows they are linked to, for viewing.

    Neighbouring tables are searched whole unless ``neighbour_cap`` limits them
    to their first rows (``NEIGHBOUR_CAP`` gives the quick view). ``truncated``
    says that the root, a capped neighbour or the edges go on. The root's
    rows, a few hundred at most, are the small side of every join.
    """
    if not 1 <= limit <= ROOT_MOST:
        raise ValueError(f"limit must be between 1 and {ROOT_MOST}")
    if not 1 <= edge_cap <= EDGE_MOST:
        raise ValueError(f"edge_cap must be between 1 and {EDGE_MOST}")
    position = F.col(ROW_ID)
    page = tables[root].where(position < limit)
    followed = plan_links(links, tables, root)

    def side(name: str) -> DataFrame:
        if name == root:
            return F.broadcast(page)
        other = tables[name]
        return other if neighbour_cap is None else other.where(position < neighbour_cap)

    root_nodes = _nodes(page, root, content)
    more_rows = tables[root].where(position >= limit).limit(1).agg((F.count("*") > 0).alias("more"))
    if not followed:
        none = tables[root].sparkSession.createDataFrame([], _EDGE_SCHEMA)
        return RowGraph(root_nodes, none, more_rows.select(F.col("more").alias("truncated")))

    all_edges = _union_edges([(k, row_edges(side(k.from_table), side(k.to_table), k)) for k in followed])
    kept, capped = cap_edges(all_edges, edge_cap)
    neighbours = sorted({name for k in followed for name in (k.from_table, k.to_table)} - {root})
    ends = kept.select(
        F.inline(
            F.array(
                F.struct(F.col("source_table").alias("table"), F.col("source_pos").alias("pos")),
                F.struct(F.col("target_table").alias("table"), F.col("target_pos").alias("pos")),
            )
        )
    )
    nodes = [root_nodes]
    for name in neighbours:
        # At most two ends per kept edge, so the set of touched rows is small.
        touched = ends.where(F.col("table") == name).select(F.col("pos").alias(ROW_ID))
        nodes.append(_nodes(side(name).join(F.broadcast(touched), ROW_ID, "left_semi"), name, content))
    left_out = [capped, more_rows.select(F.col("more").alias("capped"))]
    if neighbour_cap is not None:
        left_out += [
            tables[name].where(position >= neighbour_cap).limit(1).agg((F.count("*") > 0).alias("capped"))
            for name in neighbours
        ]
    truncated = union_all(left_out).agg(F.bool_or("capped").alias("truncated"))
    return RowGraph(union_all(nodes), with_edge_ids(kept), truncated)


_EDGE_SCHEMA = (
    "link_ord int, source_table string, source_pos bigint, target_table string, target_pos bigint, "
    "label string, source string, target string, id string"
)


def full_row_graph(
    tables: dict[str, DataFrame],
    links: DataFrame,
    most_edges: int | None = None,
    hot_rows: int = HOT_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Every edge between the rows of all linked tables, by position; see ``with_edge_ids``.

    With ``most_edges`` the edges are counted from per-key counts first, and a
    graph of more raises before any pair is made. Keys with ``hot_rows`` rows
    and more on a side are dealt over cells.
    """
    followed = plan_links(links, tables)
    if not followed:
        return next(iter(tables.values())).sparkSession.createDataFrame([], _EDGE_SCHEMA).drop("source", "target", "id")
    if most_edges is not None:
        n_edges = row_edge_counts(tables, followed).agg(F.sum("n_edges")).first()[0]
        if n_edges > most_edges:
            raise ValueError(f"the links give {n_edges} edges, over the {most_edges} allowed")
    hot = hot_keys(tables, followed, hot_rows)
    return _union_edges(
        [
            (link, row_edges(tables[link.from_table], tables[link.to_table], link, hot.get(link.ord), cell_rows))
            for link in followed
        ]
    )
