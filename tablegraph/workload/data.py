"""Inputs of the registered queries: the given tables, and catalogs derived from them.

A derivation is one SQL text that Spark and the checking engine both run, with
a placeholder per given table, so both sides start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablegraph.operators.positions import parquet_with_row_id
from tablegraph.session import configure

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its name, with the SQL of its expected result."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir.rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def placed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table with ``_row_id`` in stored order."""
    return parquet_with_row_id(spark, f"{sf}/{name}.parquet")


def derive(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(**{name: f"parquet.`{sf}/{name}.parquet`" for name in TABLES}))


def oracle(sql: str) -> str:
    """The same derivation over the given tables by name."""
    return sql.format(**{name: name for name in TABLES})


# Sessions: one per customer.
SESSIONS = """
SELECT c_custkey AS session_id,
       CASE c_nationkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'sql' ELSE 'parquet' END AS format,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'uploading' WHEN 'BUILDING' THEN 'queued'
            WHEN 'FURNITURE' THEN 'processing' WHEN 'HOUSEHOLD' THEN 'ready' ELSE 'failed' END AS status,
       c_nationkey % 6 AS total_files,
       CAST(floor(c_acctbal) AS BIGINT) AS total_size_bytes,
       TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 97 AS INT) AS created_at
FROM {customer}
"""

# Stored files: one per document; a third of them were uploaded in one session.
FILES = """
SELECT CASE WHEN lang <> 'en' THEN CAST(-1 AS BIGINT) ELSE CAST(floor(doc_id / 5.0) AS BIGINT) END AS session_id,
       doc_id, 'doc_' || CAST(doc_id % 4 AS VARCHAR(9)) || '.csv' AS filename, text
FROM {documents}
"""

# A manifest as sent: one file per document. Batches are small but for one,
# which holds the third of the files that is not in English.
MANIFEST = """
SELECT CASE WHEN lang <> 'en' THEN CAST(-1 AS BIGINT) ELSE CAST(floor(doc_id / 5.0) AS BIGINT) END AS batch,
       doc_id AS pos,
       CASE doc_id % 31
         WHEN 0 THEN 'up/load/' || CAST(doc_id AS VARCHAR(20)) || '.csv'
         WHEN 3 THEN 'C:' || chr(92) || 'Users' || chr(92) || CAST(doc_id AS VARCHAR(20)) || '.CSV'
         WHEN 5 THEN '.hidden'
         WHEN 7 THEN 'same.csv'
         WHEN 8 THEN 'other/same.csv'
         WHEN 9 THEN 'up/same.csv'
         WHEN 12 THEN CAST(doc_id AS VARCHAR(20)) || '.json'
         WHEN 15 THEN CAST(doc_id AS VARCHAR(20)) || '.txt'
         WHEN 18 THEN 'noextension'
         WHEN 21 THEN '../../etc/' || CAST(doc_id AS VARCHAR(20)) || '.tar.csv'
         WHEN 24 THEN '../..'
         ELSE CAST(doc_id AS VARCHAR(20)) || '.csv' END AS filename,
       CASE WHEN doc_id % 29 = 11 THEN ''
            WHEN doc_id % 29 IN (21, 22, 23) THEN 'copy ' || CAST(CAST(floor(doc_id / 5.0) AS BIGINT) AS VARCHAR(20))
            ELSE text END AS content
FROM {documents}
"""

# Jobs: one per event.
JOBS = """
SELECT event_id AS job_id, user_id AS session_id,
       CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed'
            ELSE 'processing' END AS status,
       CAST(event_id % 4 AS INT) AS attempt_count,
       CASE WHEN event_type = 'error' THEN props END AS error_message,
       ts AS queued_at,
       CASE WHEN event_type <> 'signup' THEN ts + INTERVAL '1' SECOND * CAST(floor(value) AS INT) END AS started_at,
       CASE WHEN event_type IN ('purchase', 'error')
            THEN ts + INTERVAL '1' SECOND * CAST(floor(value * 2) AS INT) END AS completed_at
FROM {events}
"""

# Catalog tables: one per order and one per part, spread over seven sessions.
CATALOG_TABLES = """
SELECT o_orderkey % 7 AS session_id, o_orderkey AS table_id,
       'orders_' || CAST(o_orderkey AS VARCHAR(20)) AS name, CAST(floor(o_totalprice) AS BIGINT) AS row_count
FROM {orders}
UNION ALL
SELECT p_partkey % 7 AS session_id, -1 - p_partkey AS table_id,
       'part_' || CAST(p_partkey AS VARCHAR(20)) AS name, CAST(p_size AS BIGINT) AS row_count
FROM {part}
"""

# Catalog columns: one per order line.
CATALOG_COLUMNS = """
SELECT l_orderkey AS table_id, l_linenumber - 1 AS position,
       'col_' || CAST(l_linenumber AS VARCHAR(9)) AS name,
       CASE WHEN l_linenumber = 1 THEN 'int64' WHEN l_returnflag = 'A' THEN 'float64'
            WHEN l_returnflag = 'R' THEN 'DECIMAL(10, 2)' WHEN l_linestatus = 'O' THEN 'interval' ELSE 'object' END
            AS inferred_type
FROM {lineitem}
"""

# Links: one per order line, from the order's table to the part's. Some are
# composite, some name no column, and many lead to a table of another session.
CATALOG_LINKS = """
SELECT l_orderkey % 7 AS session_id,
       'orders_' || CAST(l_orderkey AS VARCHAR(20)) AS from_table,
       CASE WHEN l_quantity = 1 THEN 'orders_' || CAST(l_orderkey AS VARCHAR(20))
            WHEN l_quantity = 2 THEN 'ghost'
            ELSE 'part_' || CAST(l_partkey AS VARCHAR(20)) END AS to_table,
       CASE WHEN l_tax > 0.07 THEN 'CHECKED_KEY' ELSE 'FOREIGN_KEY' END AS type,
       CASE l_linenumber WHEN 1 THEN 'part_id' WHEN 2 THEN 'manager_id' WHEN 3 THEN 'plant,part'
            WHEN 4 THEN 'sku' WHEN 5 THEN '' WHEN 6 THEN 'ID'
            ELSE 'Part_' || CAST(l_partkey AS VARCHAR(20)) || '_ID' END AS from_column,
       CASE WHEN l_returnflag = 'R' THEN CAST(NULL AS VARCHAR(20)) WHEN l_linenumber = 3 THEN 'plant,part'
            ELSE 'p_partkey' END AS to_column,
       CASE WHEN l_discount > 0.05 THEN CAST(NULL AS VARCHAR(20)) ELSE 'uses' END AS name,
       CASE WHEN l_discount > 0.05 THEN CAST(NULL AS VARCHAR(20)) ELSE 'is used by' END AS inverse_name,
       l_shipdate AS declared_at
FROM {lineitem}
"""


def cte(**parts: str) -> str:
    """Derivations as named parts of one oracle query."""
    named = ",\n".join(f"{name} AS ({oracle(sql).strip()})" for name, sql in parts.items())
    return f"WITH {named}\n".replace("TIMESTAMP_NTZ '", "TIMESTAMP '")
