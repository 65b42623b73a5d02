"""Catalog, paging and job-ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegraph.operators import catalog as C
from tablegraph.operators import ledger as G
from tablegraph.operators import paging as P
from tablegraph.operators.positions import ROW_ID, with_row_id
from tablegraph.plans.ingest import ingest
from tablegraph.plans.schema_graph import schema_graph
from tablegraph.session import work_path
from tablegraph.workload.files import dump_files
from tablegraph.workload.data import (
    CATALOG_COLUMNS,
    CATALOG_TABLES,
    FILES,
    JOBS,
    SESSIONS,
    TABLES,
    cte,
    derive,
    placed,
    query,
    table,
)

NOW = "2024-01-15 00:00:00"


def _now():
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


# --- stored tables and their description -----------------------------------


@query("parquet_scan", "SELECT * FROM orders")
def parquet_scan(spark, sf):
    return placed(spark, sf, "orders").drop(ROW_ID)


@query(
    "sink_roundtrip",
    """SELECT o_orderkey - (SELECT min(o_orderkey) FROM orders) AS _row_id, o_orderkey, o_custkey, o_orderstatus,
       o_totalprice, o_orderdate, o_orderpriority FROM orders""",
)
def sink_roundtrip(spark, sf):
    root = work_path(spark, "sink")
    orders = placed(spark, sf, "orders")
    # Written twice, as a repeated job would; the second run replaces the first.
    C.write_table(orders, root, "s1", "orders")
    return spark.read.parquet(C.write_table(orders, root, "s1", "orders"))


@query("catalog_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS row_count FROM {n}" for n in TABLES))
def catalog_tables(spark, sf):
    return C.catalog_tables({name: table(spark, sf, name) for name in TABLES}).select("name", "row_count")


def _columns_sql(name, columns):
    parts = []
    for i, (column, label) in enumerate(columns):
        gap = "'float64'" if label.startswith("int") else f"'{label}'"
        parts.append(
            f"""SELECT '{name}' AS "table", {i} AS position, '{column}' AS name,
            CASE WHEN (SELECT count(*) - count({column}) FROM {name}) > 0 THEN {gap} ELSE '{label}' END AS inferred_type"""
        )
    return " UNION ALL ".join(parts)


# The given tables' columns by kind.
_COLUMNS = {
    "region": "r_regionkey:int32 r_name:object",
    "nation": "n_nationkey:int32 n_name:object n_regionkey:int32",
    "customer": "c_custkey:int64 c_name:object c_nationkey:int32 c_acctbal:float64 c_mktsegment:object",
    "supplier": "s_suppkey:int64 s_name:object s_nationkey:int32 s_acctbal:float64",
    "part": "p_partkey:int64 p_name:object p_brand:object p_type:object p_size:int32 p_retailprice:float64",
    "orders": "o_orderkey:int64 o_custkey:int64 o_orderstatus:object o_totalprice:float64 o_orderdate:datetime64[us] o_orderpriority:object",
    "lineitem": "l_orderkey:int64 l_partkey:int64 l_suppkey:int64 l_linenumber:int32 l_quantity:float64 l_extendedprice:float64 "
    "l_discount:float64 l_tax:float64 l_returnflag:object l_linestatus:object l_shipdate:datetime64[us]",
    "events": "event_id:int64 ts:datetime64[us] user_id:int64 event_type:object value:float64 props:object",
    "documents": "doc_id:int64 text:object lang:object source:object n_chars:int64",
    "embeddings": "vec_id:int64 embedding:object label:int32",
    "pages": "page_id:int64 url:object html:object",
    "benchmark": "item_id:int64 text:object",
    "labels": "doc_id:int64 quality:int32 toxic:int32",
    "conversations": "conv_id:int64 turn:int64 role:object text:object",
}
_COLUMNS = {name: [tuple(column.split(":", 1)) for column in columns.split()] for name, columns in _COLUMNS.items()}


@query("catalog_columns", " UNION ALL ".join(_columns_sql(name, columns) for name, columns in _COLUMNS.items()))
def catalog_columns(spark, sf):
    return C.catalog_columns({name: table(spark, sf, name) for name in TABLES})


@query(
    "ingest_catalog",
    " UNION ALL ".join(
        f"SELECT 's1' AS session_id, '{name}' AS name, count(*) AS row_count, {len(columns)} AS n_columns FROM {name}"
        for name, columns in _COLUMNS.items()
    ),
)
def ingest_catalog(spark, sf):
    source, out = work_path(spark, "upload"), work_path(spark, "ingest")
    for name in TABLES:
        table(spark, sf, name).write.parquet(f"{source}/{name}.parquet")
    ingest(spark, source, "parquet", out, "s1")
    columns = C.read_catalog(spark, out, "columns").groupBy("session_id", F.col("table").alias("name")).agg(
        F.count("*").alias("n_columns")
    )
    return (
        C.read_catalog(spark, out, "tables")
        .join(columns, ["session_id", "name"])
        .select("session_id", "name", "row_count", "n_columns")
    )


_CATALOG = cte(t=CATALOG_TABLES, c=CATALOG_COLUMNS, s=SESSIONS, f=FILES, j=JOBS)


@query(
    "tables_with_columns",
    _CATALOG
    + """SELECT t.session_id, t.table_id, t.name, t.row_count,
          (SELECT string_agg(c.position || ':' || c.name || ':' || c.inferred_type, ','
                             ORDER BY c.position, c.name, c.inferred_type) FROM c WHERE c.table_id = t.table_id) AS columns
          FROM t""",
)
def tables_with_columns(spark, sf):
    listing = C.table_listing(derive(spark, sf, CATALOG_TABLES), derive(spark, sf, CATALOG_COLUMNS))
    shown = F.transform("columns", lambda c: F.concat_ws(":", c["position"], c["name"], c["inferred_type"]))
    return listing.select("session_id", "table_id", "name", "row_count", F.array_join(shown, ",").alias("columns"))


@query(
    "table_columns_long",
    _CATALOG
    + """SELECT t.table_id, t.name, c.position, c.name AS "column", c.inferred_type FROM t LEFT JOIN c USING (table_id)""",
)
def table_columns_long(spark, sf):
    return C.table_columns(derive(spark, sf, CATALOG_TABLES), derive(spark, sf, CATALOG_COLUMNS)).select(
        "table_id", "name", "position", "column", "inferred_type"
    )


@query(
    "numeric_columns",
    _CATALOG
    + """SELECT table_id, position, name, inferred_type FROM c
         WHERE regexp_matches(lower(inferred_type), 'int|float|double|decimal|numeric|real')""",
)
def numeric_columns(spark, sf):
    return C.numeric_columns(derive(spark, sf, CATALOG_COLUMNS))


@query(
    "catalog_replace",
    _CATALOG
    + """, gone AS (SELECT session_id FROM s WHERE status = 'ready')
    SELECT session_id, table_id, name, row_count FROM t WHERE session_id NOT IN (SELECT session_id FROM gone)
    UNION ALL
    SELECT session_id, table_id, name || '_v2', row_count + 1 FROM t
    WHERE session_id IN (SELECT session_id FROM gone) AND row_count > 100""",
)
def catalog_replace(spark, sf):
    tables = derive(spark, sf, CATALOG_TABLES)
    again = derive(spark, sf, SESSIONS).where(F.col("status") == "ready").select("session_id")
    new = (
        tables.join(again, "session_id", "left_semi")
        .where(F.col("row_count") > 100)
        .select(
            "session_id",
            "table_id",
            F.concat("name", F.lit("_v2")).alias("name"),
            (F.col("row_count") + 1).alias("row_count"),
        )
    )
    return C.replace_session(tables, new, again)


@query(
    "session_delete_cascade",
    _CATALOG
    + """, gone AS (SELECT session_id FROM s WHERE status IN ('ready', 'failed') AND total_files < 3)
    SELECT 'sessions' AS part, session_id, count(*) AS n FROM s WHERE session_id NOT IN (SELECT session_id FROM gone) GROUP BY ALL
    UNION ALL SELECT 'files', session_id, count(*) FROM f WHERE session_id NOT IN (SELECT session_id FROM gone) GROUP BY ALL
    UNION ALL SELECT 'jobs', session_id, count(*) FROM j WHERE session_id NOT IN (SELECT session_id FROM gone) GROUP BY ALL
    UNION ALL SELECT 'tables', session_id, count(*) FROM t WHERE session_id NOT IN (SELECT session_id FROM gone) GROUP BY ALL""",
)
def session_delete_cascade(spark, sf):
    sessions = derive(spark, sf, SESSIONS)
    left = C.delete_session(
        sessions,
        {
            "files": derive(spark, sf, FILES),
            "jobs": derive(spark, sf, JOBS),
            "tables": derive(spark, sf, CATALOG_TABLES),
        },
        sessions.where(F.col("total_files") < 3),
    )
    parts = [
        df.groupBy("session_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "session_id", "n")
        for name, df in left.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "session_filenames",
    _CATALOG + "SELECT s.session_id, s.status, f.filename FROM s LEFT JOIN f USING (session_id)",
)
def session_filenames(spark, sf):
    return C.session_list(derive(spark, sf, SESSIONS), derive(spark, sf, FILES)).select(
        "session_id", "status", "filename"
    )


@query(
    "session_page_filenames",
    _CATALOG
    + """, p AS (SELECT * FROM s ORDER BY created_at DESC, session_id LIMIT 50)
    SELECT p.session_id, coalesce(string_agg(f.filename, ',' ORDER BY f.filename), '') AS filenames
    FROM p LEFT JOIN f USING (session_id) GROUP BY 1""",
)
def session_page_filenames(spark, sf):
    page = P.session_page(derive(spark, sf, SESSIONS), limit=P.SESSION_LIST_ROWS)
    listed = C.with_file_names(page, derive(spark, sf, FILES))
    return listed.select("session_id", F.array_join("filenames", ",").alias("filenames"))


@query(
    "lookup_found",
    _CATALOG
    + """, r AS (SELECT DISTINCT l_orderkey + CASE WHEN l_linenumber = 7 THEN 1000000000 ELSE 0 END AS table_id FROM lineitem)
    SELECT r.table_id, t.name, t.table_id IS NOT NULL AS found FROM r LEFT JOIN t USING (table_id)""",
)
def lookup_found(spark, sf):
    requested = (
        table(spark, sf, "lineitem")
        .select(
            (F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 1000000000).otherwise(0)).alias("table_id")
        )
        .distinct()
    )
    return C.get_table(derive(spark, sf, CATALOG_TABLES), requested).select("table_id", "name", "found")


@query(
    "list_tables",
    _CATALOG
    + """, r AS (SELECT DISTINCT user_id * 3 AS session_id FROM events)
    SELECT r.session_id, r.session_id IN (SELECT session_id FROM s) AS found, t.name
    FROM r LEFT JOIN t USING (session_id)""",
)
def list_tables(spark, sf):
    requested = table(spark, sf, "events").select((F.col("user_id") * 3).alias("session_id")).distinct()
    return C.list_tables(derive(spark, sf, SESSIONS), derive(spark, sf, CATALOG_TABLES), requested).select(
        "session_id", "found", "name"
    )


@query(
    "catalog_audit",
    _CATALOG
    + """SELECT 'session_without_files' AS rule, CAST(session_id AS VARCHAR) AS subject FROM s WHERE total_files <= 0
    UNION ALL SELECT 'session_without_bytes', CAST(session_id AS VARCHAR) FROM s WHERE total_size_bytes <= 0
    UNION ALL SELECT 'file_hash_repeated', sha256(text) FROM f GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'file_name_repeated', session_id || '/' || filename FROM f GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'file_empty', session_id || '/' || filename FROM f WHERE text = ''
    UNION ALL SELECT 'table_name_repeated', session_id || '/' || name FROM t GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'table_row_count', CAST(table_id AS VARCHAR) FROM t WHERE row_count < 0
    UNION ALL SELECT 'column_name_repeated', table_id || '/' || name FROM c GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'job_attempts', CAST(job_id AS VARCHAR) FROM j WHERE attempt_count < 0""",
)
def catalog_audit(spark, sf):
    files = derive(spark, sf, FILES).withColumns(
        {"sha256": F.sha2(F.col("text").cast("binary"), 256), "size": F.octet_length("text")}
    )
    return C.audit_catalog(
        sessions=derive(spark, sf, SESSIONS),
        files=files,
        tables=derive(spark, sf, CATALOG_TABLES),
        columns=derive(spark, sf, CATALOG_COLUMNS),
        jobs=derive(spark, sf, JOBS),
    )


# --- pages ------------------------------------------------------------------

_PLACED = "WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_id FROM orders)"
_ORDER_COLUMNS = "_row_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query(
    "row_page",
    f"{_PLACED} SELECT {_ORDER_COLUMNS} FROM p ORDER BY _row_id LIMIT 500 OFFSET 1000",
)
def row_page(spark, sf):
    root = work_path(spark, "page")
    stored = spark.read.parquet(C.write_table(placed(spark, sf, "orders"), root, "s1", "orders"))
    return P.read_page(stored, offset=1000, limit=500)


@query("row_preview", f"{_PLACED} SELECT {_ORDER_COLUMNS} FROM p ORDER BY _row_id LIMIT 5")
def row_preview(spark, sf):
    return P.read_page(placed(spark, sf, "orders"), 0, P.PREVIEW_ROWS)


@query(
    "page_info",
    """SELECT 1000 AS "offset", 50 AS "limit", count(*) AS total_rows,
       CASE WHEN count(*) > 1000 THEN 1001 END AS first_row,
       CASE WHEN count(*) > 1000 THEN least(1050, count(*)) END AS last_row,
       TRUE AS has_previous, count(*) > 1050 AS has_next FROM orders""",
)
def page_info(spark, sf):
    return P.page_info(table(spark, sf, "orders"), 1000, 50)


@query(
    "row_position",
    """SELECT event_id, row_number() OVER (ORDER BY user_id, ts) - 1 AS _row_id FROM events""",
)
def row_position(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return with_row_id(events, "user_id", "ts").select("event_id", ROW_ID)


@query("row_position_stored", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS _row_id FROM documents")
def row_position_stored(spark, sf):
    return placed(spark, sf, "documents").select("doc_id", ROW_ID)


@query(
    "session_page",
    _CATALOG
    + """SELECT session_id, format, status, created_at, (SELECT count(*) FROM s) AS total
         FROM s ORDER BY created_at DESC, session_id LIMIT 20 OFFSET 40""",
)
def session_page(spark, sf):
    page = P.session_page(derive(spark, sf, SESSIONS), limit=20, offset=40)
    return page.select("session_id", "format", "status", "created_at", "total")


# --- job ledger ---------------------------------------------------------------

_JOBS = cte(j=JOBS, s=SESSIONS)
_EXPIRED = f"status = 'processing' AND started_at < TIMESTAMP '{NOW}' - INTERVAL '600' SECOND"
_JOB_COLUMNS = ["job_id", "session_id", "status", "attempt_count", "queued_at", "started_at"]
_JOB_LIST = ", ".join(_JOB_COLUMNS)


def _jobs(spark, sf):
    return derive(spark, sf, JOBS)


@query(
    "latest_job",
    _JOBS
    + f"""SELECT {_JOB_LIST} FROM
       (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY queued_at DESC, job_id DESC) AS rn FROM j)
       WHERE rn = 1""",
)
def latest_job(spark, sf):
    return G.latest_job(_jobs(spark, sf)).select(*_JOB_COLUMNS)


@query(
    "session_status",
    _JOBS
    + """, n AS (SELECT session_id, status, error_message FROM
       (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY queued_at DESC, job_id DESC) AS rn FROM j)
       WHERE rn = 1)
    SELECT s.session_id, s.format, s.status, n.status AS job_status, n.error_message
    FROM s LEFT JOIN n USING (session_id)""",
)
def session_status(spark, sf):
    return G.session_status(derive(spark, sf, SESSIONS), _jobs(spark, sf)).select(
        "session_id", "format", "status", "job_status", "error_message"
    )


_MSGS = """
SELECT event_id AS msg_id, CASE WHEN event_type = 'view' AND value > 50 THEN event_id + 1000000000
  WHEN value < 5 THEN CAST(0 AS BIGINT) ELSE event_id END AS job_id FROM {events}
"""


@query(
    "job_delivery_verdict",
    cte(j=JOBS, m=_MSGS)
    + f"""SELECT m.msg_id, m.job_id, CASE WHEN j.job_id IS NULL THEN 'missing'
       WHEN status IN ('done', 'failed') THEN 'already_settled'
       WHEN status = 'queued' OR ({_EXPIRED}) THEN 'claimable' ELSE 'in_progress' END AS verdict
       FROM m LEFT JOIN j USING (job_id)""",
)
def job_delivery_verdict(spark, sf):
    return G.delivery_verdict(derive(spark, sf, _MSGS), _jobs(spark, sf), _now())


@query("expired_leases", _JOBS + f"SELECT {_JOB_LIST} FROM j WHERE {_EXPIRED}")
def expired_leases(spark, sf):
    return G.expired_leases(_jobs(spark, sf), _now()).select(*_JOB_COLUMNS)


# Results: each claim reports once; some were taken over a second later.
_RESULTS = """
SELECT event_id AS job_id,
       ts + INTERVAL '1' SECOND * CAST(floor(value) + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS started_at,
       event_id % 2 = 0 AS succeeded, event_id % 3 = 0 AS permanent, 'row ' || CAST(event_id AS VARCHAR(20)) AS message
FROM {events}
"""
_RESULTS_CTE = cte(j=JOBS, r=_RESULTS)


@query(
    "fenced_results",
    _RESULTS_CTE
    + """SELECT job_id, r.started_at, succeeded, permanent, message FROM r JOIN j USING (job_id)
         WHERE j.status = 'processing' AND j.started_at = r.started_at""",
)
def fenced_results(spark, sf):
    return G.accepted_results(derive(spark, sf, _RESULTS), _jobs(spark, sf))


@query(
    "superseded_results",
    _RESULTS_CTE
    + """SELECT job_id, message FROM r WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.job_id = r.job_id
         AND j.status = 'processing' AND j.started_at = r.started_at)""",
)
def superseded_results(spark, sf):
    return G.superseded_results(derive(spark, sf, _RESULTS), _jobs(spark, sf)).select("job_id", "message")


@query(
    "job_state_after",
    _RESULTS_CTE
    + f""", x AS (SELECT j.*, r.succeeded, r.message, r.job_id IS NOT NULL AS told,
                 permanent OR attempt_count >= 3 AS final
          FROM j LEFT JOIN r ON r.job_id = j.job_id AND j.status = 'processing' AND j.started_at = r.started_at)
    SELECT job_id, session_id, CASE WHEN NOT told THEN status WHEN succeeded THEN 'done' WHEN final THEN 'failed'
             ELSE 'queued' END AS status, attempt_count,
           CASE WHEN NOT told THEN error_message WHEN NOT succeeded THEN message END AS error_message,
           CASE WHEN told AND (succeeded OR final) THEN TIMESTAMP '{NOW}' ELSE completed_at END AS completed_at,
           CASE WHEN NOT told THEN NULL WHEN succeeded THEN 'ready' WHEN final THEN 'failed' END AS session_status
    FROM x""",
)
def job_state_after(spark, sf):
    after = G.apply_results(_jobs(spark, sf), derive(spark, sf, _RESULTS), _now())
    return after.drop("queued_at", "started_at")


_FAILURES = """
SELECT event_id AS job_id, CAST(event_id % 5 AS INT) AS attempt,
       CASE event_type WHEN 'error' THEN 'permanent' WHEN 'view' THEN 'held' ELSE 'transient' END AS outcome
FROM {events}
"""


@query(
    "retry_routing",
    cte(f=_FAILURES)
    + """SELECT job_id, attempt, outcome,
      CASE WHEN outcome = 'held' THEN 'retry' WHEN outcome = 'permanent' OR attempt + 1 >= 3 THEN 'dead' ELSE 'retry' END AS route,
      CASE WHEN outcome = 'held' THEN 30 WHEN outcome = 'permanent' OR attempt + 1 >= 3 THEN NULL
           WHEN attempt = 0 THEN 5 ELSE 25 END AS delay_seconds,
      CASE WHEN outcome = 'transient' AND attempt + 1 < 3 THEN attempt + 1 ELSE attempt END AS next_attempt FROM f""",
)
def retry_routing(spark, sf):
    return G.route_failures(derive(spark, sf, _FAILURES))


@query(
    "stuck_jobs",
    _JOBS + f"SELECT {_JOB_LIST} FROM j WHERE status = 'queued' AND queued_at < TIMESTAMP '{NOW}' - INTERVAL '5' MINUTE",
)
def stuck_jobs(spark, sf):
    return G.stuck_jobs(_jobs(spark, sf), _now()).select(*_JOB_COLUMNS)


@query("queue_depth", _JOBS + "SELECT status, count(*) AS n_jobs FROM j GROUP BY 1")
def queue_depth(spark, sf):
    return G.queue_depth(_jobs(spark, sf))


# --- the stored catalog ---------------------------------------------------------


def _load(spark, sf, out, session, *names):
    source = work_path(spark, "upload")
    for name in names:
        table(spark, sf, name).write.parquet(f"{source}/{name}.parquet")
    ingest(spark, source, "parquet", out, session)


def _stored_rows(spark, out):
    """What the stored catalog lists, with the rows found at each path."""
    tables = C.read_catalog(spark, out, "tables")
    # One row per table of the few that the query loaded.
    counts = [(row["table_id"], spark.read.parquet(row["parquet_path"]).count()) for row in tables.collect()]
    found = spark.createDataFrame(counts, "table_id string, n_rows bigint")
    columns = C.read_catalog(spark, out, "columns").groupBy("table_id").agg(F.count("*").alias("n_columns"))
    return tables.join(found, "table_id").join(columns, "table_id").select("session_id", "name", "row_count", "n_rows", "n_columns")


@query(
    "catalog_replace_stored",
    """SELECT 'a' AS session_id, 'supplier' AS name, count(*) AS row_count, count(*) AS n_rows, 4 AS n_columns FROM supplier
       UNION ALL SELECT 'b', 'region', count(*), count(*), 2 FROM region""",
)
def catalog_replace_stored(spark, sf):
    out = work_path(spark, "stored")
    _load(spark, sf, out, "a", "nation", "region")
    _load(spark, sf, out, "b", "region")
    _load(spark, sf, out, "a", "supplier")
    return _stored_rows(spark, out)


@query(
    "session_delete_stored",
    """SELECT 'b' AS session_id, 'nation' AS name, count(*) AS row_count, count(*) AS n_rows, 3 AS n_columns FROM nation
       UNION ALL SELECT 'c', 'region', count(*), count(*), 2 FROM region""",
)
def session_delete_stored(spark, sf):
    out = work_path(spark, "stored")
    for session, name in (("a", "supplier"), ("b", "nation"), ("c", "region")):
        _load(spark, sf, out, session, name)
    states = [("a", "ready"), ("b", "processing"), ("c", "failed")]
    sessions = spark.createDataFrame(states, "session_id string, status string")
    for _ in range(2):  # a repeated call changes nothing
        C.delete_stored(sessions, out, sessions.where("session_id in ('a', 'b')"))
    return _stored_rows(spark, out)


@query(
    "stored_schema_graph",
    """SELECT 'node' AS kind, name, row_count, column_count, CAST(NULL AS VARCHAR) AS to_name FROM (
         SELECT 'region' AS name, 0 AS row_count, 2 AS column_count UNION ALL SELECT 'nation', 0, 3
         UNION ALL SELECT 'empty_table', 0, 2 UNION ALL SELECT 'customer', count(*), 7 FROM customer
         UNION ALL SELECT 'supplier', 2 * count(*), 4 FROM supplier)
       UNION ALL SELECT 'edge', * FROM (VALUES ('nation', NULL, NULL, 'region'), ('customer', NULL, NULL, 'nation'),
         ('supplier', NULL, NULL, 'supplier'), ('supplier', NULL, NULL, 'nation')) v(name, row_count, column_count, to_name)""",
)
def stored_schema_graph(spark, sf):
    out = work_path(spark, "stored")
    ingest(spark, dump_files(spark, sf), "sql", out, "s1")
    tables, columns, links = (C.read_catalog(spark, out, name) for name in ("tables", "columns", "links"))
    graph = schema_graph(tables, columns, links, session_id="s1")
    names = tables.select("table_id", "name")
    ends = [names.select(F.col("table_id").alias(f"{end}_table_id"), F.col("name").alias(f"{end}_name")) for end in ("from", "to")]
    edges = graph.edges.select("from_table_id", "to_table_id").join(ends[0], "from_table_id").join(ends[1], "to_table_id")
    none = F.lit(None).cast("bigint")
    return graph.nodes.select(
        F.lit("node").alias("kind"), "name", "row_count", "column_count", F.lit(None).cast("string").alias("to_name")
    ).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("from_name").alias("name"), none.alias("row_count"), none.alias("column_count"), "to_name")
    )
