"""Row graphs over the given tables, and schema graphs over the derived catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegraph.functions.phrases import edge_label, link_names
from tablegraph.functions.text import edge_id, join_key, row_id, row_label, value_text
from tablegraph.operators import links as L
from tablegraph.operators.positions import ROW_ID
from tablegraph.plans import row_graph as R
from tablegraph.plans.schema_graph import graph_summary, schema_graph
from tablegraph.workload.data import (
    CATALOG_COLUMNS,
    CATALOG_LINKS,
    CATALOG_TABLES,
    cte,
    derive,
    placed,
    query,
    table,
)

# The foreign keys of the given tables, as a catalog would declare them. One
# is declared twice, one is composite, one names no column, one leads nowhere.
FOREIGN_KEYS = [
    ("orders", "customer", "FOREIGN_KEY", "o_custkey", "c_custkey"),
    ("orders", "customer", "CHECKED_KEY", "o_custkey", "c_custkey"),
    ("customer", "nation", "FOREIGN_KEY", "c_nationkey", "n_nationkey"),
    ("supplier", "nation", "FOREIGN_KEY", "s_nationkey", "n_nationkey"),
    ("nation", "region", "FOREIGN_KEY", "n_regionkey", "r_regionkey"),
    ("lineitem", "orders", "FOREIGN_KEY", "l_orderkey", "o_orderkey"),
    ("lineitem", "part", "FOREIGN_KEY", "l_partkey", "p_partkey"),
    ("lineitem", "supplier", "FOREIGN_KEY", "l_suppkey", "s_suppkey"),
    ("labels", "documents", "FOREIGN_KEY", "doc_id", "doc_id"),
    ("lineitem", "part", "FOREIGN_KEY", "l_partkey,l_suppkey", "p_partkey,p_size"),
    ("lineitem", "region", "FOREIGN_KEY", None, None),
    ("orders", "ghost", "FOREIGN_KEY", "o_ghost", "g_key"),
]
LINKED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels"]


def declared_links(spark, rows=None):
    """Foreign keys with the phrases they read as."""
    links = spark.createDataFrame(
        rows or FOREIGN_KEYS, "from_table string, to_table string, type string, from_column string, to_column string"
    )
    name, inverse = link_names(F.col("from_column"), F.col("to_table"))
    return links.withColumns({"name": name, "inverse_name": inverse})


def linked_tables(spark, sf, names=None):
    return {name: placed(spark, sf, name) for name in names or LINKED}


# Positions are stored order. All tables but one are stored by their key.
POSITIONS = """
p_region AS (SELECT r_regionkey AS k, row_number() OVER (ORDER BY r_regionkey) - 1 AS pos FROM region),
p_nation AS (SELECT n_nationkey AS k, n_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation),
p_customer AS (SELECT c_custkey AS k, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer),
p_supplier AS (SELECT s_suppkey AS k, s_nationkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier),
p_part AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part),
p_orders AS (SELECT o_orderkey AS k, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders),
p_lineitem AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER () - 1 AS pos FROM lineitem),
p_documents AS (SELECT doc_id AS k, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
p_labels AS (SELECT doc_id AS k, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM labels)
"""


def _edges(source, column, target, label="belongs to"):
    return f"""SELECT '{source}' AS st, s.pos AS sp, '{target}' AS tt, t.pos AS tp, '{label}' AS label
               FROM p_{source} s JOIN p_{target} t ON s.{column} = t.k"""


ALL_EDGES = " UNION ALL ".join(
    [
        _edges("orders", "o_custkey", "customer"),
        _edges("customer", "c_nationkey", "nation"),
        _edges("supplier", "s_nationkey", "nation"),
        _edges("nation", "n_regionkey", "region"),
        _edges("lineitem", "l_orderkey", "orders"),
        _edges("lineitem", "l_partkey", "part"),
        _edges("lineitem", "l_suppkey", "supplier"),
        _edges("labels", "k", "documents", "belongs to doc"),
    ]
)
EDGE_TEXT = """st || '#' || CAST(sp AS VARCHAR) || '|' || tt || '#' || CAST(tp AS VARCHAR) || '|' || label AS id,
  st || '#' || CAST(sp AS VARCHAR) AS source, tt || '#' || CAST(tp AS VARCHAR) AS target, label"""


@query("row_edges_full", f"WITH {POSITIONS}, e AS ({ALL_EDGES}) SELECT {EDGE_TEXT} FROM e")
def row_edges_full(spark, sf):
    edges = R.full_row_graph(linked_tables(spark, sf), declared_links(spark))
    return R.with_edge_ids(edges).select("id", "source", "target", "label")


@query(
    "row_edges_distinct",
    f"WITH {POSITIONS}, e AS ({_edges('orders', 'o_custkey', 'customer')}) SELECT DISTINCT {EDGE_TEXT} FROM e",
)
def row_edges_distinct(spark, sf):
    # The same key declared twice gives each edge twice.
    tables = linked_tables(spark, sf, ["orders", "customer"])
    twice = [R.Link(i, "orders", "customer", "o_custkey", "c_custkey", "belongs to") for i in range(2)]
    edges = R.row_edges(tables["orders"], tables["customer"], twice[0]).unionByName(
        R.row_edges(tables["orders"], tables["customer"], twice[1])
    )
    return R.with_edge_ids(R.distinct_edges(edges)).select("id", "source", "target", "label")


@query(
    "row_edge_counts",
    """
    WITH pairs AS (
      SELECT 'lineitem' AS from_table, 'orders' AS to_table, 'l_orderkey' AS from_column,
             (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS n_edges,
             (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS n_sources,
             (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) AS n_keys
      UNION ALL
      SELECT 'documents', 'documents', 'source',
             (SELECT CAST(sum(n * n) AS BIGINT) FROM (SELECT count(*) AS n FROM documents GROUP BY source)),
             (SELECT count(source) FROM documents), (SELECT count(DISTINCT source) FROM documents)
      UNION ALL
      SELECT 'events', 'customer', 'user_id',
             (SELECT count(*) FROM events JOIN customer ON user_id = c_custkey),
             (SELECT count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM customer)),
             (SELECT count(DISTINCT user_id) FROM events WHERE user_id IN (SELECT c_custkey FROM customer)))
    SELECT from_table, to_table, from_column, n_edges, n_sources, n_keys FROM pairs
    """,
)
def row_edge_counts(spark, sf):
    tables = linked_tables(spark, sf, ["lineitem", "orders", "documents", "events", "customer"])
    links = [
        R.Link(0, "lineitem", "orders", "l_orderkey", "o_orderkey", "belongs to"),
        R.Link(1, "documents", "documents", "source", "source", "same source"),
        R.Link(2, "events", "customer", "user_id", "c_custkey", "belongs to user"),
    ]
    return R.row_edge_counts(tables, links)


@query(
    "row_edges_text_keys",
    """
    WITH s AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN CAST('nan' AS DOUBLE)
                           WHEN c_custkey % 7 = 2 THEN CAST('inf' AS DOUBLE)
                           WHEN c_custkey % 7 = 3 THEN c_nationkey + 0.5 ELSE c_nationkey END AS k, c_custkey AS pos
               FROM customer)
    SELECT s.pos AS source_pos, n.n_nationkey AS target_pos FROM s
    JOIN nation n ON s.k = n.n_nationkey AND NOT isnan(s.k) AND NOT isinf(s.k)
    """,
)
def row_edges_text_keys(spark, sf):
    key = F.expr(
        "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN double('nan') "
        "WHEN c_custkey % 7 = 2 THEN double('inf') WHEN c_custkey % 7 = 3 THEN c_nationkey + 0.5D "
        "ELSE double(c_nationkey) END"
    )
    src = placed(spark, sf, "customer").withColumn("k", key)
    dst = placed(spark, sf, "nation")
    return R.row_edges(src, dst, R.Link(0, "customer", "nation", "k", "n_nationkey", "x")).select(
        "source_pos", "target_pos"
    )


_SELF = """
WITH p AS (SELECT c_custkey AS k, CAST(floor(c_custkey / 10.0) AS BIGINT) AS manager_id,
                  row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
"""


@query(
    "self_link_edges",
    _SELF
    + """SELECT 'customer#' || CAST(s.pos AS VARCHAR) AS source, 'customer#' || CAST(t.pos AS VARCHAR) AS target,
         'belongs to manager' AS label FROM p s JOIN p t ON s.manager_id = t.k""",
)
def self_link_edges(spark, sf):
    staff = placed(spark, sf, "customer").withColumn(
        "manager_id", F.floor(F.col("c_custkey") / 10).cast("bigint")
    )
    links = declared_links(spark, [("customer", "customer", "FOREIGN_KEY", "manager_id", "c_custkey")])
    edges = R.full_row_graph({"customer": staff}, links)
    return R.with_edge_ids(edges).select("source", "target", "label")


@query(
    "row_ids",
    """SELECT 'lineitem#' || CAST(row_number() OVER () - 1 AS VARCHAR) AS id, l_orderkey, l_linenumber FROM lineitem""",
)
def row_ids(spark, sf):
    rows = placed(spark, sf, "lineitem")
    return rows.select(row_id("lineitem", F.col(ROW_ID)).alias("id"), "l_orderkey", "l_linenumber")


@query(
    "edge_ids",
    """SELECT 'orders#' || CAST(o_orderkey AS VARCHAR) || '|customer#' || CAST(o_custkey AS VARCHAR) || '|placed by'
       AS id FROM orders""",
)
def edge_ids(spark, sf):
    return table(spark, sf, "orders").select(
        edge_id(row_id("orders", F.col("o_orderkey")), row_id("customer", F.col("o_custkey")), F.lit("placed by")).alias("id")
    )


_ORDERS_GRAPH = f"""
WITH {POSITIONS},
root AS (SELECT * FROM p_orders ORDER BY pos LIMIT 50),
e AS (
  SELECT 0 AS ord, 'lineitem' AS st, l.pos AS sp, 'orders' AS tt, r.pos AS tp, 'belongs to' AS label
  FROM p_lineitem l JOIN root r ON l.l_orderkey = r.k
  UNION ALL
  SELECT 1, 'orders', r.pos, 'customer', c.pos, 'belongs to' FROM root r JOIN p_customer c ON r.o_custkey = c.k),
kept AS (SELECT * FROM e ORDER BY ord, sp, tp LIMIT 2000)
"""


def _orders_graph(spark, sf, **options):
    tables = linked_tables(spark, sf, ["lineitem", "orders", "customer"])
    return R.row_graph(tables, declared_links(spark), "orders", **options)


@query("row_graph_edges", _ORDERS_GRAPH + f"SELECT {EDGE_TEXT} FROM kept")
def row_graph_edges(spark, sf):
    return _orders_graph(spark, sf).edges.select("id", "source", "target", "label")


@query(
    "row_graph_nodes",
    _ORDERS_GRAPH
    + """
    , ends AS (SELECT st AS t, sp AS p FROM kept UNION SELECT tt, tp FROM kept)
    SELECT 'orders#' || CAST(pos AS VARCHAR) AS id, 'orders' AS "table", pos, CAST(k AS VARCHAR) AS label FROM root
    UNION ALL
    SELECT 'customer#' || CAST(pos AS VARCHAR), 'customer', pos, CAST(k AS VARCHAR) FROM p_customer
    WHERE pos IN (SELECT p FROM ends WHERE t = 'customer')
    UNION ALL
    SELECT 'lineitem#' || CAST(pos AS VARCHAR), 'lineitem', pos, CAST(l_orderkey AS VARCHAR) FROM p_lineitem
    WHERE pos IN (SELECT p FROM ends WHERE t = 'lineitem')
    """,
)
def row_graph_nodes(spark, sf):
    return _orders_graph(spark, sf).nodes


@query(
    "row_graph_truncated",
    _ORDERS_GRAPH
    + """SELECT (SELECT count(*) FROM orders) > 50 OR (SELECT count(*) FROM e) > 2000 AS truncated""",
)
def row_graph_truncated(spark, sf):
    return _orders_graph(spark, sf).truncated


@query(
    "row_graph_summary",
    _ORDERS_GRAPH
    + """, ends AS (SELECT st AS t, sp AS p FROM kept UNION SELECT tt, tp FROM kept)
    SELECT (SELECT count(*) FROM root) + (SELECT count(*) FROM ends WHERE t <> 'orders') AS n_nodes,
           (SELECT count(*) FROM kept) AS n_edges""",
)
def row_graph_summary(spark, sf):
    graph = _orders_graph(spark, sf)
    return graph_summary(graph.nodes, graph.edges)


@query(
    "row_graph_neighbour_cap",
    f"""WITH {POSITIONS},
    root AS (SELECT * FROM p_orders ORDER BY pos LIMIT 50),
    e AS (
      SELECT 'lineitem' AS st, l.pos AS sp, 'orders' AS tt, r.pos AS tp, 'belongs to' AS label
      FROM (SELECT * FROM p_lineitem ORDER BY pos LIMIT 500) l JOIN root r ON l.l_orderkey = r.k
      UNION ALL
      SELECT 'orders', r.pos, 'customer', c.pos, 'belongs to' FROM root r
      JOIN (SELECT * FROM p_customer ORDER BY pos LIMIT 500) c ON r.o_custkey = c.k)
    SELECT {EDGE_TEXT} FROM e""",
)
def row_graph_neighbour_cap(spark, sf):
    graph = _orders_graph(spark, sf, neighbour_cap=R.NEIGHBOUR_CAP)
    return graph.edges.select("id", "source", "target", "label")


_NATION_GRAPH = f"""
WITH {POSITIONS},
e AS (
  SELECT 0 AS ord, 'customer' AS st, c.pos AS sp, 'nation' AS tt, n.pos AS tp, 'belongs to' AS label
  FROM p_customer c JOIN p_nation n ON c.c_nationkey = n.k
  UNION ALL
  SELECT 1, 'nation', n.pos, 'region', r.pos, 'belongs to' FROM p_nation n JOIN p_region r ON n.n_regionkey = r.k
  UNION ALL
  SELECT 2, 'supplier', s.pos, 'nation', n.pos, 'belongs to' FROM p_supplier s JOIN p_nation n ON s.s_nationkey = n.k)
"""


def _nation_graph(spark, sf):
    tables = linked_tables(spark, sf, ["region", "nation", "customer", "supplier"])
    return R.row_graph(tables, declared_links(spark), "nation", edge_cap=1000)


@query("row_edges_capped", _NATION_GRAPH + f"SELECT {EDGE_TEXT} FROM (SELECT * FROM e ORDER BY ord, sp, tp LIMIT 1000) k")
def row_edges_capped(spark, sf):
    return _nation_graph(spark, sf).edges.select("id", "source", "target", "label")


@query("row_edges_capped_flag", _NATION_GRAPH + "SELECT count(*) > 1000 AS truncated FROM e")
def row_edges_capped_flag(spark, sf):
    return _nation_graph(spark, sf).truncated


_KEY_CASES = """
SELECT c_custkey,
       CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN CAST('nan' AS DOUBLE)
            WHEN c_custkey % 7 = 2 THEN CAST('inf' AS DOUBLE) WHEN c_custkey % 7 = 3 THEN CAST('-inf' AS DOUBLE)
            WHEN c_custkey % 7 = 4 THEN c_acctbal ELSE CAST(c_custkey AS DOUBLE) * 1000003 END AS k
FROM {customer}
"""


@query(
    "join_key_normalise",
    cte(c=_KEY_CASES)
    + """SELECT c_custkey, CASE WHEN k IS NULL OR isnan(k) OR isinf(k) THEN NULL
         WHEN k = floor(k) THEN CAST(CAST(k AS BIGINT) AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS join_key FROM c""",
)
def join_key_normalise(spark, sf):
    keys = derive(spark, sf, _KEY_CASES)
    return keys.select("c_custkey", join_key(F.col("k"), keys.schema["k"].dataType).alias("join_key"))


@query(
    "value_texts",
    """SELECT event_id, CAST(value AS VARCHAR) AS value_text, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text,
       CASE WHEN value > 100 THEN 'True' ELSE 'False' END AS flag_text FROM events""",
)
def value_texts(spark, sf):
    events = table(spark, sf, "events").withColumn("flag", F.col("value") > 100)
    kinds = {f.name: f.dataType for f in events.schema.fields}
    return events.select(
        "event_id",
        value_text(F.col("value"), kinds["value"]).alias("value_text"),
        value_text(F.col("ts"), kinds["ts"]).alias("ts_text"),
        value_text(F.col("flag"), kinds["flag"]).alias("flag_text"),
    )


_LABEL_CASES = """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS a,
       CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS b
FROM {documents}
"""


@query(
    "row_label",
    cte(d=_LABEL_CASES)
    + """SELECT doc_id, substr(coalesce(a, CASE WHEN b THEN 'True' WHEN NOT b THEN 'False' END,
         'row ' || CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR)), 1, 32) AS label FROM d""",
)
def row_labels(spark, sf):
    rows = placed(spark, sf, "documents").withColumns(
        {
            "a": F.when(F.col("doc_id") % 3 != 0, F.col("text")),
            "b": F.when(F.col("doc_id") % 6 != 0, F.col("doc_id") % 2 == 0),
        }
    )
    return rows.select("doc_id", row_label(rows, F.col(ROW_ID), ["a", "b"]).alias("label"))


def catalog(spark, sf):
    return (
        derive(spark, sf, CATALOG_TABLES),
        derive(spark, sf, CATALOG_COLUMNS),
        derive(spark, sf, CATALOG_LINKS),
    )


_CATALOG = cte(t=CATALOG_TABLES, c=CATALOG_COLUMNS, l=CATALOG_LINKS)
_LABEL = """CASE WHEN name IS NOT NULL THEN name WHEN coalesce(from_column, '') = '' THEN replace(lower(type), '_', ' ')
  ELSE from_column || ' → ' || coalesce(to_column, '?') END"""


@query(
    "schema_nodes",
    _CATALOG
    + """SELECT t.session_id, t.table_id, t.name, t.row_count, coalesce(n, 0) AS column_count
         FROM t LEFT JOIN (SELECT table_id, count(*) AS n FROM c GROUP BY table_id) USING (table_id)""",
)
def schema_nodes(spark, sf):
    return schema_graph(*catalog(spark, sf)).nodes


@query(
    "schema_edges",
    _CATALOG
    + f"""SELECT l.session_id, a.table_id AS from_table_id, b.table_id AS to_table_id, l.from_table, l.to_table, type,
          {_LABEL.replace('name', 'l.name').replace('l.l.name', 'l.name')} AS label
          FROM l JOIN t a ON a.session_id = l.session_id AND a.name = l.from_table
          JOIN t b ON b.session_id = l.session_id AND b.name = l.to_table""",
)
def schema_edges(spark, sf):
    return schema_graph(*catalog(spark, sf)).edges.select(
        "session_id", "from_table_id", "to_table_id", "from_table", "to_table", "type", "label"
    )


@query(
    "schema_graph_summary",
    _CATALOG
    + """, e AS (SELECT l.session_id FROM l JOIN t a ON a.session_id = l.session_id AND a.name = l.from_table
          JOIN t b ON b.session_id = l.session_id AND b.name = l.to_table)
       SELECT s.session_id, s.n_nodes, coalesce(k.n_edges, 0) AS n_edges
       FROM (SELECT session_id, count(*) AS n_nodes FROM t GROUP BY 1) s
       LEFT JOIN (SELECT session_id, count(*) AS n_edges FROM e GROUP BY 1) k USING (session_id)""",
)
def schema_graph_summary(spark, sf):
    graph = schema_graph(*catalog(spark, sf))
    return graph_summary(graph.nodes, graph.edges, by=["session_id"])


@query(
    "graph_summary",
    _CATALOG
    + """SELECT (SELECT count(*) FROM t WHERE session_id = 3) AS n_nodes,
       (SELECT count(*) FROM l JOIN t a ON a.session_id = l.session_id AND a.name = l.from_table
          JOIN t b ON b.session_id = l.session_id AND b.name = l.to_table WHERE l.session_id = 3) AS n_edges""",
)
def graph_summary_one(spark, sf):
    graph = schema_graph(*catalog(spark, sf), session_id=3)
    return graph_summary(graph.nodes, graph.edges)


_LINK_COLUMNS = ["session_id", "from_table", "to_table", "type", "from_column", "to_column"]
_LINK_LIST = ", ".join(_LINK_COLUMNS)


@query(
    "dangling_links",
    _CATALOG
    + f"""SELECT {_LINK_LIST}, CASE WHEN a IS NULL AND b IS NULL THEN 'both' WHEN a IS NULL THEN 'from' ELSE 'to' END AS missing
      FROM (SELECT l.*, (SELECT 1 FROM t WHERE t.session_id = l.session_id AND t.name = l.from_table) AS a,
                   (SELECT 1 FROM t WHERE t.session_id = l.session_id AND t.name = l.to_table) AS b FROM l)
      WHERE a IS NULL OR b IS NULL""",
)
def dangling_links(spark, sf):
    tables, _, links = catalog(spark, sf)
    return L.dangling_links(tables, links).select(*_LINK_COLUMNS, "missing")


_USABLE = """coalesce(from_column, '') <> '' AND coalesce(to_column, '') <> ''
  AND NOT contains(from_column, ',') AND NOT contains(to_column, ',')"""


@query("usable_links", _CATALOG + f"SELECT {_LINK_LIST} FROM l WHERE {_USABLE}")
def usable_links(spark, sf):
    return L.usable_links(catalog(spark, sf)[2]).select(*_LINK_COLUMNS)


@query(
    "neighbour_tables",
    _CATALOG
    + f""", u AS (SELECT * FROM l WHERE {_USABLE} AND from_table <> to_table),
      p AS (SELECT session_id, from_table AS a, to_table AS b FROM u
            UNION SELECT session_id, to_table, from_table FROM u)
      SELECT p.session_id, p.a AS "table", p.b AS neighbour FROM p
      WHERE EXISTS (SELECT 1 FROM t WHERE t.session_id = p.session_id AND t.name = p.a)
        AND EXISTS (SELECT 1 FROM t WHERE t.session_id = p.session_id AND t.name = p.b)""",
)
def neighbour_tables(spark, sf):
    tables, _, links = catalog(spark, sf)
    return L.neighbour_tables(links, tables)


@query(
    "link_dedupe",
    _CATALOG
    + """SELECT session_id, from_table, to_table, type, nullif(from_column, '') AS from_column, to_column, name, inverse_name
      FROM (SELECT *, row_number() OVER (
              PARTITION BY session_id, from_table, to_table, type, coalesce(from_column, ''), coalesce(to_column, '')
              ORDER BY declared_at, name NULLS FIRST) AS rn FROM l) WHERE rn = 1""",
)
def link_dedupe(spark, sf):
    return L.dedupe_links(catalog(spark, sf)[2], ["declared_at"], within=["session_id"])


_ROLE = """CASE WHEN ends_with(lower(from_column), '_id') AND NOT contains(from_column, ',') AND length(from_column) > 3
  THEN left(lower(from_column), length(from_column) - 3) END"""


@query(
    "link_names",
    _CATALOG
    + f""", r AS (SELECT from_column, split_part(to_table, '_', 1) || 's' AS to_table, {_ROLE} AS role FROM l),
      q AS (SELECT from_column, to_table, CASE WHEN
              (CASE WHEN length(role) > 2 AND ends_with(role, 's') THEN left(role, length(role) - 1) ELSE role END)
              = (CASE WHEN length(to_table) > 2 AND ends_with(to_table, 's') THEN left(to_table, length(to_table) - 1)
                 ELSE to_table END) THEN NULL ELSE role END AS role FROM r)
      SELECT from_column, to_table, 'belongs to' || coalesce(' ' || role, '') AS name,
             'has many' || coalesce(' ' || role, '') AS inverse_name FROM q""",
)
def link_phrases(spark, sf):
    links = catalog(spark, sf)[2].select(
        "from_column", F.concat(F.split_part("to_table", F.lit("_"), F.lit(1)), F.lit("s")).alias("to_table")
    )
    name, inverse = link_names(F.col("from_column"), F.col("to_table"))
    return links.withColumns({"name": name, "inverse_name": inverse})


@query("edge_labels", _CATALOG + f"SELECT {_LINK_LIST}, {_LABEL} AS label FROM l")
def edge_labels(spark, sf):
    label = edge_label(F.col("name"), F.col("from_column"), F.col("to_column"), F.col("type"))
    return catalog(spark, sf)[2].select(*_LINK_COLUMNS, label.alias("label"))


_COLUMNS_TEXT = """CASE WHEN coalesce(from_column, '') = '' THEN replace(lower(type), '_', ' ')
  ELSE from_column || ' → ' || coalesce(to_column, '?') END"""


@query(
    "directed_links",
    _CATALOG
    + f"""SELECT session_id, from_table AS node, '→' AS direction, coalesce(name, {_COLUMNS_TEXT}) AS phrase,
             to_table AS other, {_COLUMNS_TEXT} AS columns FROM l
      UNION ALL
      SELECT session_id, to_table, '←', coalesce(inverse_name, {_COLUMNS_TEXT}), from_table, {_COLUMNS_TEXT}
      FROM l WHERE from_table <> to_table""",
)
def directed_links(spark, sf):
    return L.directed_links(catalog(spark, sf)[2])


@query(
    "directed_links_of_node",
    _CATALOG
    + f"""SELECT session_id, to_table AS node, '←' AS direction, coalesce(inverse_name, {_COLUMNS_TEXT}) AS phrase,
             from_table AS other, {_COLUMNS_TEXT} AS columns FROM l WHERE to_table = 'ghost'""",
)
def directed_links_of_node(spark, sf):
    return L.directed_links(catalog(spark, sf)[2], "ghost")


@query(
    "directed_row_links",
    f"""WITH {POSITIONS}, e AS ({_edges('orders', 'o_custkey', 'customer')}), i AS (SELECT {EDGE_TEXT} FROM e)
      SELECT source AS node, '→' AS direction, label, target AS other FROM i
      UNION ALL SELECT target, '←', label, source FROM i""",
)
def directed_row_links(spark, sf):
    tables = linked_tables(spark, sf, ["orders", "customer"])
    link = R.Link(0, "orders", "customer", "o_custkey", "c_custkey", "belongs to")
    return L.directed_row_links(R.with_edge_ids(R.row_edges(tables["orders"], tables["customer"], link)))


_NEAR = f"WITH {POSITIONS}, e AS ({ALL_EDGES}), i AS (SELECT {EDGE_TEXT} FROM e)"


def _near_nation(spark, sf):
    names = ["region", "nation", "customer", "supplier"]
    tables = linked_tables(spark, sf, names)
    edges = R.with_edge_ids(R.full_row_graph(tables, declared_links(spark)))
    parts = [tables[name].select(row_id(name, F.col(ROW_ID)).alias("id")) for name in names]
    nodes = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return L.closed_neighbourhood(nodes, edges, "nation#7")


@query(
    "closed_neighbourhood",
    _NEAR
    + """SELECT DISTINCT id FROM (SELECT source AS id FROM i WHERE target = 'nation#7'
         UNION ALL SELECT target FROM i WHERE source = 'nation#7' UNION ALL SELECT 'nation#7')""",
)
def closed_neighbourhood(spark, sf):
    return _near_nation(spark, sf)[0]


@query(
    "closed_neighbourhood_edges",
    _NEAR + "SELECT id, source, target, label FROM i WHERE source = 'nation#7' OR target = 'nation#7'",
)
def closed_neighbourhood_edges(spark, sf):
    return _near_nation(spark, sf)[1].select("id", "source", "target", "label")
