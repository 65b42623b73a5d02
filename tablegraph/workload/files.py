"""Reader queries: the given tables rendered as CSV, JSON and dump texts, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.operators.profile import normalize_missing, profile_types
from tablegraph.session import work_path
from tablegraph.sources import csv as V
from tablegraph.sources import dump as D
from tablegraph.sources import json as J
from tablegraph.workload.data import ORACLES, cte, derive, query, table

# --- CSV ----------------------------------------------------------------------


def _as_csv(df: DataFrame, name: str) -> str:
    """Render a table as one CSV file (a folder of parts, each with the header)."""
    root = work_path(df.sparkSession, "csv")
    df.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(f"{root}/{name}.csv")
    return root


def _as_lines(df: DataFrame, header: str, name: str) -> str:
    """Render ready-made lines under a header, quoting nothing."""
    root = work_path(df.sparkSession, "lines")
    lines = df.select(F.col("line").alias(header))
    lines.write.option("header", "true").option("sep", "\x01").option("quote", "\x02").csv(f"{root}/{name}.csv")
    return root


# Names with separators, quotes and line ends inside.
_PEOPLE = """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || ', "the first"' WHEN 1 THEN c_name || chr(10) || 'second line'
       ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment, c_acctbal > 0 AS c_positive
FROM {customer}
"""


@query(
    "csv_scan",
    cte(p=_PEOPLE)
    + "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, c_positive FROM p",
)
def csv_scan(spark, sf):
    return V.read_csv_tables(spark, _as_csv(derive(spark, sf, _PEOPLE), "people"))["people"]


# Every text on more than one line, so that each record spans lines.
_LETTERS = """
SELECT doc_id, 'text:' || chr(10) || coalesce(text, '') || chr(10) || '"end", ' AS body, 'l-' || coalesce(lang, '') AS lang
FROM {documents}
"""


@query("csv_quoted_lines", cte(l=_LETTERS) + "SELECT doc_id, body, lang FROM l")
def csv_quoted_lines(spark, sf):
    root = _as_csv(derive(spark, sf, _LETTERS), "letters")
    return V.read_csv_tables(spark, root, split_bytes=0)["letters"]


@query("csv_positions", "SELECT o_orderkey, o_orderkey - (SELECT min(o_orderkey) FROM orders) AS _row_id FROM orders")
def csv_positions(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    tables = V.read_csv_tables(spark, _as_csv(orders, "orders"), positions=True)
    return tables["orders"].select("o_orderkey", "_row_id")


_RAGGED = """
SELECT o_orderkey, o_custkey, o_orderpriority, o_orderkey % 7 AS c,
       CAST(o_orderkey AS VARCHAR(20)) || ',' || CAST(o_custkey AS VARCHAR(20))
       || CASE o_orderkey % 7 WHEN 0 THEN ',' || o_orderpriority || ',extra' WHEN 1 THEN ',' || o_orderpriority || ','
               WHEN 2 THEN '' WHEN 3 THEN ',' || o_orderpriority || ',,"x,y"' ELSE ',' || o_orderpriority END AS line
FROM {orders}
"""


def _ragged(spark, sf):
    root = _as_lines(derive(spark, sf, _RAGGED), "id,customer,priority", "ragged")
    return V.scan_csv(spark, root)["ragged"]


@query(
    "csv_ragged_audit",
    cte(r=_RAGGED)
    + "SELECT CAST(o_orderkey AS VARCHAR) AS id, line AS record, CASE c WHEN 0 THEN 4 ELSE 5 END AS n_fields FROM r WHERE c IN (0, 3)",
)
def csv_ragged_audit(spark, sf):
    return V.csv_surplus_rows(_ragged(spark, sf), 3).select(
        "id", F.regexp_replace(V.RECORD, r"[\r\n]+$", "").alias("record"), "n_fields"
    )


@query(
    "csv_short_rows",
    cte(r=_RAGGED)
    + """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS customer,
         CASE WHEN c <> 2 THEN o_orderpriority END AS priority FROM r""",
)
def csv_short_rows(spark, sf):
    return _ragged(spark, sf).select("id", "customer", "priority")


_GAPS = """
SELECT c_custkey, CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN 'null' WHEN 3 THEN 'N/A'
       WHEN 4 THEN 'None' WHEN 5 THEN '#N/A' WHEN 6 THEN '-nan' WHEN 7 THEN ' NA' WHEN 8 THEN 'none'
       ELSE c_mktsegment END AS segment
FROM {customer}
"""


@query(
    "csv_missing_tokens",
    cte(g=_GAPS) + "SELECT c_custkey, CASE WHEN c_custkey % 11 < 7 THEN NULL ELSE segment END AS segment FROM g",
)
def csv_missing_tokens(spark, sf):
    return V.read_csv_tables(spark, _as_csv(derive(spark, sf, _GAPS), "gaps"))["gaps"]


@query("normalize_missing", cte(g=_GAPS) + "SELECT c_custkey, CASE WHEN c_custkey % 11 < 7 THEN NULL ELSE segment END AS segment FROM g")
def missing_in_columns(spark, sf):
    return normalize_missing(derive(spark, sf, _GAPS))


# One column per outcome of type inference.
_TYPED = """
SELECT CAST(event_id AS VARCHAR(20)) AS whole,
       CASE WHEN event_type = 'error' THEN 'NA' ELSE CAST(user_id AS VARCHAR(20)) END AS gapped,
       CASE WHEN event_type = 'view' THEN '1e5' WHEN event_type = 'click' THEN '-inf' ELSE CAST(user_id AS VARCHAR(20)) || '.5' END AS number,
       CASE WHEN value > 50 THEN 'True' ELSE 'false' END AS flag,
       CASE WHEN event_type = 'error' THEN '' WHEN value > 50 THEN 'True' ELSE 'false' END AS gapped_flag,
       event_type AS words, CAST(CAST(ts AS DATE) AS VARCHAR(20)) AS day, 'NA' AS nothing,
       '1844674407370955' || CAST(1000 + event_id % 615 AS VARCHAR(20)) AS wide,
       '99999999999999999999' || CAST(event_id AS VARCHAR(20)) AS wider,
       CASE WHEN event_type = 'view' THEN '1d' ELSE '2' END AS suffixed
FROM {events}
"""


@query(
    "infer_csv_types",
    cte(t=_TYPED)
    + """SELECT * FROM (
      SELECT 0 AS position, 'whole' AS "column", CASE WHEN count(try_cast(whole AS BIGINT)) = count(*) THEN 'int64' ELSE 'object' END AS inferred_type FROM t
      UNION ALL SELECT 1, 'gapped', CASE WHEN count(*) FILTER (gapped = 'NA') > 0 THEN 'float64' ELSE 'int64' END FROM t
      UNION ALL SELECT 2, 'number', CASE WHEN count(try_cast(number AS DOUBLE)) = count(*) THEN 'float64' ELSE 'object' END FROM t
      UNION ALL SELECT 3, 'flag', CASE WHEN count(*) = count(*) FILTER (flag IN ('True', 'false')) THEN 'bool' ELSE 'object' END FROM t
      UNION ALL SELECT 4, 'gapped_flag', CASE WHEN count(*) FILTER (gapped_flag = '') > 0 THEN 'object' ELSE 'bool' END FROM t
      UNION ALL SELECT 5, 'words', CASE WHEN count(try_cast(words AS DOUBLE)) = 0 THEN 'object' ELSE '?' END FROM t
      UNION ALL SELECT 6, 'day', CASE WHEN count(try_cast(day AS DOUBLE)) = 0 THEN 'object' ELSE '?' END FROM t
      UNION ALL SELECT 7, 'nothing', CASE WHEN count(*) FILTER (nothing <> 'NA') = 0 THEN 'float64' ELSE '?' END FROM t
      UNION ALL SELECT 8, 'wide', CASE WHEN count(try_cast(wide AS UBIGINT)) = count(*) THEN 'uint64' ELSE 'object' END FROM t
      UNION ALL SELECT 9, 'wider', CASE WHEN count(try_cast(wider AS UBIGINT)) = 0 THEN 'object' ELSE '?' END FROM t
      UNION ALL SELECT 10, 'suffixed', CASE WHEN count(*) FILTER (suffixed = '1d') > 0 THEN 'object' ELSE '?' END FROM t)""",
)
def infer_csv_types(spark, sf):
    return profile_types(normalize_missing(derive(spark, sf, _TYPED)))


# --- JSON ---------------------------------------------------------------------

# One document per order. By key: an object, an array with stray items, an
# object of record sets, or something that is not a table.
_DOCS = """
SELECT 'o' || CAST(o_orderkey AS VARCHAR(20)) AS name, o_orderkey, o_custkey, o_orderstatus, o_orderkey % 5 AS c,
  CASE o_orderkey % 5
    WHEN 0 THEN '{{"id":' || CAST(o_orderkey AS VARCHAR(20)) || ',"customer":{{"key":' || CAST(o_custkey AS VARCHAR(20))
         || ',"geo":{{"status":"' || o_orderstatus || '","lat":21.0}}}},"tags":null,"e":{{}}}}'
    WHEN 1 THEN '[{{"id":' || CAST(o_orderkey AS VARCHAR(20)) || '}},5,"{{}}",null,[1],{{"id":-1,"x":true}}]'
    WHEN 2 THEN '{{"lines":[{{"k":1}},{{"k":' || CAST(o_custkey AS VARCHAR(20)) || '}}],"n":3,"none":[],"more":[{{"s":"' || o_orderstatus || '"}}]}}'
    WHEN 3 THEN '42'
    ELSE '{{"id":' END AS doc
FROM {orders}
"""


@query(
    "json_root_kind",
    cte(d=_DOCS)
    + """SELECT name, CASE c WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'object' WHEN 3 THEN 'scalar' ELSE 'invalid' END AS kind FROM d""",
)
def json_root_kind(spark, sf):
    docs = derive(spark, sf, _DOCS)
    return docs.select("name", J.root_kind(F.col("doc")).alias("kind"))


_RECORDS = """
SELECT name, name AS "table", 0 AS pos, doc AS record FROM d WHERE c = 0
UNION ALL SELECT name, name, 0, '{"id":' || o_orderkey || '}' FROM d WHERE c = 1
UNION ALL SELECT name, name, 1, '{"id":-1,"x":true}' FROM d WHERE c = 1
UNION ALL SELECT name, 'lines', 0, '{"k":1}' FROM d WHERE c = 2
UNION ALL SELECT name, 'lines', 1, '{"k":' || o_custkey || '}' FROM d WHERE c = 2
UNION ALL SELECT name, 'none', NULL, NULL FROM d WHERE c = 2
UNION ALL SELECT name, 'more', 0, '{"s":"' || o_orderstatus || '"}' FROM d WHERE c = 2
"""


def _documents(spark, sf):
    return derive(spark, sf, _DOCS).select("name", "doc")


@query("json_record_sets", cte(d=_DOCS) + _RECORDS)
def json_record_sets(spark, sf):
    return J.json_record_sets(_documents(spark, sf), strict=False)


@query("json_rejects", cte(d=_DOCS) + "SELECT name, CASE c WHEN 3 THEN 'scalar' ELSE 'invalid' END AS reason FROM d WHERE c > 2")
def json_rejects(spark, sf):
    return J.json_rejects(_documents(spark, sf))


@query(
    "json_skip_non_objects",
    cte(d=_DOCS) + "SELECT name, CASE c WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS n_records FROM d WHERE c < 3",
)
def json_skip_non_objects(spark, sf):
    records = J.json_record_sets(_documents(spark, sf), strict=False)
    return records.groupBy("name").agg(F.count("record").cast("int").alias("n_records"))


@query(
    "json_flatten",
    cte(d=_DOCS)
    + """SELECT name, 'id' AS path, 'integer' AS kind, CAST(o_orderkey AS VARCHAR) AS value FROM d WHERE c = 0
    UNION ALL SELECT name, 'customer.key', 'integer', CAST(o_custkey AS VARCHAR) FROM d WHERE c = 0
    UNION ALL SELECT name, 'customer.geo.status', 'string', o_orderstatus FROM d WHERE c = 0
    UNION ALL SELECT name, 'customer.geo.lat', 'float', '21.0' FROM d WHERE c = 0
    UNION ALL SELECT name, 'tags', 'null', NULL FROM d WHERE c = 0
    UNION ALL SELECT name, 'id', 'integer', CAST(o_orderkey AS VARCHAR) FROM d WHERE c = 1
    UNION ALL SELECT name, 'id', 'integer', '-1' FROM d WHERE c = 1
    UNION ALL SELECT name, 'x', 'boolean', 'true' FROM d WHERE c = 1
    UNION ALL SELECT name, 'k', 'integer', '1' FROM d WHERE c = 2
    UNION ALL SELECT name, 'k', 'integer', CAST(o_custkey AS VARCHAR) FROM d WHERE c = 2
    UNION ALL SELECT name, 's', 'string', o_orderstatus FROM d WHERE c = 2""",
)
def json_flatten(spark, sf):
    docs = _documents(spark, sf)
    deepest = docs.agg(F.max(J.nesting_depth(F.col("doc")))).first()[0]
    records = J.json_record_sets(docs, strict=False).where(F.col("record").isNotNull())
    return J.flatten_json(records, depth=deepest).select("name", "path", "kind", "value")


# One table with a record per order: absent keys, mixed kinds, nested objects,
# a list.
_MIXED = """
SELECT 'orders' AS "table", o_orderkey AS pos, o_orderkey, o_custkey, o_orderstatus, o_orderkey % 3 AS c,
  '{{"id":' || CAST(o_orderkey AS VARCHAR(20))
  || CASE o_orderkey % 3 WHEN 0 THEN ',"price":' || CAST(o_custkey AS VARCHAR(20)) || ',"flag":true,"both":true,"any":"x"'
       WHEN 1 THEN ',"price":' || CAST(o_custkey AS VARCHAR(20)) || '.25,"flag":false,"both":' || CAST(o_custkey AS VARCHAR(20)) || ',"any":7'
       ELSE ',"at":{{"status":"' || o_orderstatus || '"}}' END
  || ',"list":[1,"a"],"nothing":null}}' AS record
FROM {orders}
"""


def _mixed(spark, sf):
    return derive(spark, sf, _MIXED.replace('"table"', "table")).select("table", "pos", "record")


@query(
    "infer_json_types",
    cte(m=_MIXED)
    + """SELECT "table", path, CASE WHEN n > 0 THEN label END AS inferred_type FROM (
      SELECT 'orders' AS "table", (SELECT count(*) FROM m) AS n, unnest(['id', 'price', 'flag', 'both', 'any', 'list', 'nothing', 'at.status']) AS path,
             unnest(['integer', 'float', 'boolean', 'integer', 'string', 'array', 'null', 'string']) AS label)""",
)
def infer_json_types(spark, sf):
    return J.describe_records(_mixed(spark, sf)).select("table", "path", "inferred_type")


@query("infer_json_types_long", ORACLES["infer_json_types"])
def infer_json_types_long(spark, sf):
    return J.infer_json_types(J.flatten_json(_mixed(spark, sf))).select("table", "path", "inferred_type")


@query(
    "json_union_columns",
    cte(m=_MIXED)
    + """SELECT pos, o_orderkey AS id, CASE c WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 1 THEN o_custkey + 0.25 END AS price,
      CASE c WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag, CASE c WHEN 0 THEN 1 WHEN 1 THEN o_custkey END AS "both",
      CASE c WHEN 0 THEN 'x' WHEN 1 THEN '7' END AS "any", '[1,"a"]' AS list, CAST(NULL AS VARCHAR) AS nothing,
      CASE WHEN c = 2 THEN o_orderstatus END AS "at.status" FROM m""",
)
def json_union_columns(spark, sf):
    records = _mixed(spark, sf)
    described = J.describe_records(records).orderBy("first").collect()
    columns = [(row["path"], row["inferred_type"]) for row in described]
    return J.json_table(records, columns, J.has_dotted_keys(records)).drop("table")


# A dotted key beside a nested object of the same path: the later one counts.
_CLASH = """
SELECT 'events' AS table, event_id AS pos, event_id, user_id, event_type, event_id % 2 AS c,
  CASE event_id % 2 WHEN 0 THEN '{{"a.b":' || CAST(user_id AS VARCHAR(20)) || ',"a":{{"b":"' || event_type || '"}}}}'
       ELSE '{{"a":{{"b":"' || event_type || '"}},"a.b":' || CAST(user_id AS VARCHAR(20)) || '}}' END AS record
FROM {events}
"""


@query(
    "json_dotted_clash",
    """SELECT event_id AS pos, CASE event_id % 2 WHEN 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS "a.b" FROM events""",
)
def json_dotted_clash(spark, sf):
    records = derive(spark, sf, _CLASH).select("table", "pos", "record")
    columns = [(row["path"], row["inferred_type"]) for row in J.describe_records(records).collect()]
    return J.json_table(records, columns, J.has_dotted_keys(records)).drop("table")


@query(
    "json_events_scan",
    """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""",
)
def json_events_scan(spark, sf):
    events = table(spark, sf, "events").select(
        F.lit("events").alias("table"), F.col("event_id").alias("pos"), F.col("props").alias("record")
    )
    columns = [(row["path"], row["inferred_type"]) for row in J.describe_records(events).collect()]
    rows = J.json_table(events, columns, J.has_dotted_keys(events))
    return rows.drop("table").withColumnRenamed("pos", "event_id")


# --- SQL dumps ------------------------------------------------------------------

_SCHEMA = """-- A dump; it's made of the given tables.
SET client_encoding = 'UTF8';
DROP TABLE IF EXISTS customer;
CREATE TABLE public.region (r_regionkey INTEGER PRIMARY KEY, r_name character varying(25) NOT NULL);
CREATE TABLE nation (n_nationkey int4, n_name TEXT, n_regionkey INTEGER REFERENCES region(r_regionkey));
CREATE TABLE "customer" (
    c_custkey BIGINT, c_name TEXT DEFAULT 'x, y (z', c_nationkey INTEGER, c_acctbal numeric(12,2), c_vip boolean, c_note TEXT,
    c_missing double precision, CHECK (c_custkey >= 0),
    CONSTRAINT fk_nation FOREIGN KEY (c_nationkey) REFERENCES nation (n_nationkey) ON DELETE CASCADE
);
CREATE TABLE supplier (s_suppkey BIGINT, s_name TEXT, s_nationkey INTEGER, parent_id BIGINT REFERENCES supplier(s_suppkey),
    FOREIGN KEY (s_nationkey, s_suppkey) REFERENCES public.branch (a, b));
CREATE TABLE empty_table (id INTEGER, label TEXT);
ALTER TABLE ONLY supplier ADD CONSTRAINT s_n FOREIGN KEY (s_nationkey) REFERENCES nation;
ALTER TABLE customer OWNER TO postgres;
ALTER TABLE ghost ADD FOREIGN KEY (x) REFERENCES region (r_regionkey);
CREATE FUNCTION f() RETURNS void AS $body$ BEGIN
INSERT INTO region VALUES (99, 'not a row');
END $body$ LANGUAGE plpgsql;
TRUNCATE region;
"""

# Rendered by Spark only, where \' is a quote inside a literal.
_CUSTOMER_INSERT = r"""
SELECT 'INSERT INTO public.customer (c_custkey, c_name, c_nationkey, c_acctbal, c_vip, c_note, c_undeclared) VALUES ('
  || CAST(c_custkey AS VARCHAR(20)) || ', \'' || c_name || CASE WHEN c_custkey % 4 = 0 THEN ' (o\'\'k); --' ELSE '' END || '\', '
  || CAST(c_nationkey AS VARCHAR(20)) || ', ' || CASE WHEN c_custkey % 3 = 0 THEN 'NULL' ELSE CAST(c_nationkey AS VARCHAR(20)) || '.25' END
  || ', ' || CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'false' END
  || CASE c_custkey % 3 WHEN 0 THEN ', \'it\'\'s;' || chr(10) || 'two lines\'' WHEN 1 THEN ', now()' ELSE ', -7' END || ', 1);' AS value
FROM {customer}
"""
_SUPPLIER_INSERT = r"""
SELECT 'INSERT INTO supplier VALUES (' || CAST(s_suppkey AS VARCHAR(20)) || ', \'' || s_name || '\', '
  || CAST(s_nationkey AS VARCHAR(20)) || ', NULL), (' || CAST(-1 - s_suppkey AS VARCHAR(20)) || ', E\'a' || chr(92) || '\';b\', '
  || CAST(s_nationkey AS VARCHAR(20)) || ', ' || CAST(s_suppkey AS VARCHAR(20)) || ');' AS value
FROM {supplier}
"""
_PART_INSERT = "SELECT 'INSERT INTO part VALUES (' || CAST(p_partkey AS VARCHAR(20)) || ');' AS value FROM {part}"


# One table for each supplier, its columns, types and links made of the supplier's values; every third has rows.
_STOCK_TABLES = r"""
SELECT 'CREATE TABLE stock_' || CAST(s_suppkey AS VARCHAR(20)) || ' (id BIGINT PRIMARY KEY, "' || s_name || '" '
  || CASE s_suppkey % 3 WHEN 0 THEN 'numeric(' || CAST(s_nationkey + 5 AS VARCHAR(9)) || ', 2)' WHEN 1 THEN 'character varying(' || CAST(s_nationkey + 1 AS VARCHAR(9)) || ')' ELSE 'boolean' END
  || ' DEFAULT NULL, s_nationkey INTEGER REFERENCES nation_' || CAST(s_nationkey AS VARCHAR(9)) || '(n_nationkey)'
  || CASE WHEN s_acctbal < 5000 THEN ', parent_id BIGINT' ELSE '' END || ');' || chr(10)
  || CASE WHEN s_acctbal < 5000 THEN 'ALTER TABLE stock_' || CAST(s_suppkey AS VARCHAR(20)) || ' ADD FOREIGN KEY (parent_id, id) REFERENCES stock_'
    || CAST(s_suppkey + 1 AS VARCHAR(20)) || ' (a, b);' || chr(10) ELSE '' END
  || CASE WHEN s_suppkey % 3 = 0 THEN 'INSERT INTO stock_' || CAST(s_suppkey AS VARCHAR(20)) || ' (id) VALUES (1);' ELSE '' END AS value
FROM {supplier}
"""
_STOCK = """
SELECT 'stock_' || s_suppkey AS "table", position, name, inferred_type FROM (
  SELECT s_suppkey, 0 AS position, 'id' AS name, 'BIGINT' AS inferred_type FROM supplier
  UNION ALL SELECT s_suppkey, 1, s_name, CASE s_suppkey % 3 WHEN 0 THEN 'DECIMAL(' || (s_nationkey + 5) || ', 2)'
    WHEN 1 THEN 'VARCHAR(' || (s_nationkey + 1) || ')' ELSE 'BOOLEAN' END FROM supplier
  UNION ALL SELECT s_suppkey, 2, 's_nationkey', 'INT' FROM supplier
  UNION ALL SELECT s_suppkey, 3, 'parent_id', 'BIGINT' FROM supplier WHERE s_acctbal < 5000)
"""


def _declared(spark, sf):
    """The statements of a dump with the fixed schema and a table for each supplier."""
    root = work_path(spark, "declared")
    spark.createDataFrame([(_SCHEMA,)], "value string").coalesce(1).write.text(f"{root}/0_schema.sql")
    derive(spark, sf, _STOCK_TABLES).write.text(f"{root}/1_stock.sql")
    return D.dump_statements(spark, root)


def dump_files(spark, sf):
    """A folder of dump files, taken in name order: the schema, then rows."""
    root = work_path(spark, "dump")

    def text(df, name):
        df.write.text(f"{root}/{name}.sql")

    text(spark.createDataFrame([(_SCHEMA,)], "value string").coalesce(1), "0_schema")
    rendered = {"1_customer": _CUSTOMER_INSERT, "2_supplier": _SUPPLIER_INSERT, "3_part": _PART_INSERT}
    for name, sql in rendered.items():
        text(derive(spark, sf, sql), name)
    return root


def _dump(spark, sf):
    return D.dump_statements(spark, dump_files(spark, sf))


@query(
    "dump_statement_kinds",
    """SELECT kind, target, n FROM (
      SELECT 'insert' AS kind, 'customer' AS target, count(*) AS n FROM customer
      UNION ALL SELECT 'insert', 'supplier', count(*) FROM supplier
      UNION ALL SELECT 'insert', 'part', count(*) FROM part
      UNION ALL SELECT 'ignored', NULL, 4
      UNION ALL SELECT 'alter', unnest(['supplier', 'customer', 'ghost']), 1
      UNION ALL SELECT 'create', unnest(['region', 'nation', 'customer', 'supplier', 'empty_table']), 1)""",
)
def dump_statement_kinds(spark, sf):
    return _dump(spark, sf).groupBy("kind", "target").agg(F.count("*").alias("n"))


_DECLARED = """
SELECT * FROM (VALUES ('region', 0, 'r_regionkey', 'INT'), ('region', 1, 'r_name', 'VARCHAR(25)'),
  ('nation', 0, 'n_nationkey', 'INT'), ('nation', 1, 'n_name', 'TEXT'), ('nation', 2, 'n_regionkey', 'INT'),
  ('customer', 0, 'c_custkey', 'BIGINT'), ('customer', 1, 'c_name', 'TEXT'), ('customer', 2, 'c_nationkey', 'INT'),
  ('customer', 3, 'c_acctbal', 'DECIMAL(12, 2)'), ('customer', 4, 'c_vip', 'BOOLEAN'), ('customer', 5, 'c_note', 'TEXT'),
  ('customer', 6, 'c_missing', 'DOUBLE PRECISION'),
  ('supplier', 0, 's_suppkey', 'BIGINT'), ('supplier', 1, 's_name', 'TEXT'), ('supplier', 2, 's_nationkey', 'INT'),
  ('supplier', 3, 'parent_id', 'BIGINT'), ('empty_table', 0, 'id', 'INT'), ('empty_table', 1, 'label', 'TEXT'))
  AS v("table", position, name, inferred_type)
"""


@query("dump_columns", f"{_DECLARED} UNION ALL {_STOCK}")
def dump_columns(spark, sf):
    return D.dump_columns(_declared(spark, sf))


@query(
    "dump_links",
    """SELECT * FROM (VALUES
      ('nation', 'region', 'FOREIGN_KEY', 'n_regionkey', 'r_regionkey', 'belongs to', 'has many'),
      ('customer', 'nation', 'FOREIGN_KEY', 'c_nationkey', 'n_nationkey', 'belongs to', 'has many'),
      ('supplier', 'supplier', 'FOREIGN_KEY', 'parent_id', 's_suppkey', 'belongs to parent', 'has many parent'),
      ('supplier', 'branch', 'FOREIGN_KEY', 's_nationkey,s_suppkey', 'a,b', 'belongs to', 'has many'),
      ('supplier', 'nation', 'FOREIGN_KEY', 's_nationkey', NULL, 'belongs to', 'has many'))
      AS v(from_table, to_table, type, from_column, to_column, name, inverse_name)
    UNION ALL SELECT 'stock_' || s_suppkey, 'nation_' || s_nationkey, 'FOREIGN_KEY', 's_nationkey', 'n_nationkey', 'belongs to', 'has many' FROM supplier
    UNION ALL SELECT 'stock_' || s_suppkey, 'stock_' || (s_suppkey + 1), 'FOREIGN_KEY', 'parent_id,id', 'a,b', 'belongs to', 'has many'
      FROM supplier WHERE s_acctbal < 5000""",
)
def dump_links(spark, sf):
    return D.dump_links(_declared(spark, sf)).drop("stmt_no", "item_no")


_CUSTOMER_ROWS = """
SELECT c_custkey, c_name || CASE WHEN c_custkey % 4 = 0 THEN ' (o''k); --' ELSE '' END AS c_name,
  CAST(c_nationkey AS BIGINT) AS c_nationkey, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey + 0.25 END AS c_acctbal,
  c_acctbal > 0 AS c_vip,
  CASE c_custkey % 3 WHEN 0 THEN 'it''s;' || chr(10) || 'two lines' WHEN 1 THEN 'now()' ELSE '-7' END AS c_note,
  CAST(NULL AS VARCHAR) AS c_missing FROM customer
"""


@query("dump_rows", _CUSTOMER_ROWS)
def dump_rows(spark, sf):
    return D.dump_rows(_dump(spark, sf), "customer").drop("stmt_no", "tuple_no")


@query(
    "dump_rows_multi",
    """SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(NULL AS BIGINT) AS parent_id, 0 AS tuple_no FROM supplier
       UNION ALL SELECT -1 - s_suppkey, 'a'';b', s_nationkey, s_suppkey, 1 FROM supplier""",
)
def dump_rows_multi(spark, sf):
    return D.dump_rows(_dump(spark, sf), "supplier").drop("stmt_no")


@query(
    "dump_literals",
    """SELECT CASE c_custkey % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'expression' ELSE 'integer' END AS kind,
       CASE c_custkey % 3 WHEN 0 THEN 'it''s;' || chr(10) || 'two lines' WHEN 1 THEN 'now()' ELSE '-7' END AS value,
       count(*) AS n FROM customer GROUP BY ALL""",
)
def dump_literals(spark, sf):
    tuples = D.dump_tuples(_dump(spark, sf)).where(F.col("table") == "customer")
    kind, value = D.sql_literal(F.trim(F.get("fields", F.lit(5))))
    return tuples.select(kind.alias("kind"), value.alias("value")).groupBy("kind", "value").agg(F.count("*").alias("n"))


@query("dump_empty_table", "SELECT CAST(0 AS INTEGER) AS id, '' AS label FROM region WHERE r_regionkey < 0")
def dump_empty_table(spark, sf):
    return D.dump_rows(_dump(spark, sf), "empty_table").drop("stmt_no", "tuple_no")


@query(
    "dump_tables_without_rows",
    f"""SELECT * FROM ({_STOCK}) AS s WHERE CAST(substr("table", 7) AS BIGINT) % 3 <> 0
        UNION ALL {_DECLARED}""",
)
def dump_tables_without_rows(spark, sf):
    """The columns that tables keep of which the dump has no row, however many tables there are."""
    stmts = _declared(spark, sf)
    filled = D.dump_tuples(stmts).select("table").distinct()
    return D.dump_columns(stmts).join(filled, "table", "left_anti")


@query(
    "dump_all_rows",
    """SELECT 'customer' AS "table", count(*) AS n, min(c_custkey) AS least, max(c_custkey) AS most, 0 AS first, count(*) - 1 AS last, count(*) AS positions FROM customer
       UNION ALL SELECT 'supplier', 2 * count(*), min(-1 - s_suppkey), max(s_suppkey), 0, 2 * count(*) - 1, 2 * count(*) FROM supplier""",
)
def dump_all_rows(spark, sf):
    cells = D.stored_cells(_dump(spark, sf))
    key = F.get("cells", F.lit(0))["value"].cast("bigint")
    return cells.groupBy("table").agg(
        F.count("*").alias("n"),
        F.min(key).alias("least"),
        F.max(key).alias("most"),
        F.min("_row_id").alias("first"),
        F.max("_row_id").alias("last"),
        F.count_distinct("_row_id").alias("positions"),
    )


@query("dump_unread", "SELECT 'insert' AS kind, 'part' AS target, 'no_table' AS reason, count(*) AS n FROM part")
def dump_unread(spark, sf):
    return D.dump_unread(_dump(spark, sf)).groupBy("kind", "target", "reason").agg(F.count("*").alias("n"))
