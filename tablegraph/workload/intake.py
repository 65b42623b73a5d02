"""Manifest rules over the documents as uploaded files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegraph.functions.filenames import format_of, safe_filename
from tablegraph.operators import manifest as M
from tablegraph.sources.csv import header_fields
from tablegraph.workload.data import MANIFEST, cte, derive, query, table

#: The queries use a small limit, so that the rule has batches to refuse.
SMALL_BATCH_BYTES = 8000


def _manifest(spark, sf):
    return M.describe_content(derive(spark, sf, MANIFEST))


_NAMES = """
n AS (SELECT *, strlen(content) AS size, sha256(content) AS sha256,
        regexp_extract(regexp_replace(filename, '/+$', ''), '([^/]*)$', 1) AS posix FROM m0),
o AS (SELECT *, regexp_extract(regexp_replace(posix, '^[A-Za-z]:', ''), '([^' || chr(92) || chr(92) || ']*)$', 1) AS bare FROM n),
m AS (SELECT *, CASE WHEN bare <> '' AND left(bare, 1) <> '.' THEN bare END AS name,
        CASE WHEN bare <> '' AND left(bare, 1) <> '.' AND contains(bare, '.')
              AND lower(regexp_extract(bare, '[.]([^.]*)$', 1)) IN ('csv', 'json', 'sql', 'parquet')
             THEN lower(regexp_extract(bare, '[.]([^.]*)$', 1)) END AS fmt FROM o),
cnt AS (SELECT batch, count(*) AS n_files FROM m GROUP BY 1),
b AS (SELECT m.* FROM m JOIN cnt USING (batch) WHERE n_files <= 5)
"""
_M = cte(m0=MANIFEST) + "," + _NAMES


@query("manifest_sha256", _M + "SELECT batch, pos, size, sha256 FROM m")
def manifest_sha256(spark, sf):
    return _manifest(spark, sf).select("batch", "pos", "size", "sha256")


@query("safe_filename", _M + "SELECT pos, filename, name AS safe_name FROM m")
def safe_names(spark, sf):
    m = derive(spark, sf, MANIFEST)
    return m.select("pos", "filename", safe_filename(F.col("filename")).alias("safe_name"))


@query(
    "safe_filename_urls",
    """SELECT page_id, CASE WHEN b <> '' AND left(b, 1) <> '.' THEN b END AS safe_name FROM
       (SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS b FROM pages)""",
)
def safe_filename_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", safe_filename(F.col("url")).alias("safe_name"))


@query("resolve_format", _M + "SELECT pos, name, fmt AS format FROM m WHERE name IS NOT NULL")
def resolve_format(spark, sf):
    named = derive(spark, sf, MANIFEST).select("pos", safe_filename(F.col("filename")).alias("name"))
    return named.where(F.col("name").isNotNull()).withColumn("format", format_of(F.col("name")))


@query(
    "batch_file_count",
    _M + "SELECT batch, n_files, CASE WHEN n_files > 5 THEN 'too_many_files' END AS reject_reason FROM cnt",
)
def batch_file_count(spark, sf):
    return M.batch_file_count(derive(spark, sf, MANIFEST))


@query(
    "batch_without_files",
    cte(m0=MANIFEST)
    + """SELECT DISTINCT user_id AS batch, coalesce(n, 0) AS n_files,
       CASE WHEN coalesce(n, 0) = 0 THEN 'no_files' WHEN n > 5 THEN 'too_many_files' END AS reject_reason
       FROM events LEFT JOIN (SELECT batch, count(*) AS n FROM m0 GROUP BY 1) c ON c.batch = user_id""",
)
def batch_without_files(spark, sf):
    opened = table(spark, sf, "events").select(F.col("user_id").alias("batch"))
    return M.batch_file_count(derive(spark, sf, MANIFEST), opened)


@query(
    "batch_duplicate_names",
    _M
    + """SELECT batch, pos, name FROM (SELECT *, row_number() OVER (PARTITION BY batch, name ORDER BY pos) AS rn FROM b)
         WHERE name IS NOT NULL AND rn > 1""",
)
def batch_duplicate_names(spark, sf):
    return M.check_batch(_manifest(spark, sf)).where("duplicate_filename").select("batch", "pos", "name")


@query(
    "batch_mixed_formats",
    _M + "SELECT batch FROM b GROUP BY 1 HAVING count(DISTINCT fmt) > 1",
)
def batch_mixed_formats(spark, sf):
    return M.check_batch(_manifest(spark, sf)).where("mixed_formats").select("batch").distinct()


@query("batch_empty_files", _M + "SELECT batch, pos FROM b WHERE size = 0")
def batch_empty_files(spark, sf):
    return M.check_batch(_manifest(spark, sf)).where("empty_file").select("batch", "pos")


_RUNNING = f"""SELECT batch, pos, CAST(sum(size) OVER (PARTITION BY batch ORDER BY pos) AS BIGINT) AS running_size,
  sum(size) OVER (PARTITION BY batch ORDER BY pos) > {SMALL_BATCH_BYTES} AS batch_too_large, false AS too_many_files FROM b
  UNION ALL SELECT batch, pos, NULL, NULL, true FROM m JOIN cnt USING (batch) WHERE n_files > 5"""


@query("batch_running_size", _M + _RUNNING)
def batch_running_size(spark, sf):
    checked = M.check_batch(_manifest(spark, sf), max_bytes=SMALL_BATCH_BYTES)
    return checked.select("batch", "pos", "running_size", "batch_too_large", "too_many_files")


@query(
    "batch_duplicate_content",
    _M
    + """SELECT batch, pos, first_pos FROM
         (SELECT *, min(pos) OVER (PARTITION BY batch, sha256) AS first_pos FROM b) WHERE first_pos < pos""",
)
def batch_duplicate_content(spark, sf):
    return M.duplicate_content(_manifest(spark, sf)).select("batch", "pos", "first_pos")


def _known_and_new(spark, sf):
    """Documents with labels count as on record already, the others as newly sent."""
    labels = table(spark, sf, "labels").select("doc_id")
    m = _manifest(spark, sf)
    labelled = m.pos == labels.doc_id
    return m.join(labels, labelled, "left_semi"), m.join(labels, labelled, "left_anti")


_KNOWN = """, known AS (SELECT DISTINCT sha256 FROM m WHERE pos IN (SELECT doc_id FROM labels)),
fresh AS (SELECT * FROM m WHERE pos NOT IN (SELECT doc_id FROM labels))
"""


@query(
    "already_ingested",
    _M + _KNOWN + "SELECT batch, pos, sha256 FROM fresh WHERE sha256 IN (SELECT sha256 FROM known)",
)
def already_ingested(spark, sf):
    known, fresh = _known_and_new(spark, sf)
    return M.already_ingested(fresh, known).select("batch", "pos", "sha256")


@query(
    "not_yet_ingested",
    _M + _KNOWN + "SELECT batch, pos, sha256 FROM fresh WHERE sha256 NOT IN (SELECT sha256 FROM known)",
)
def not_yet_ingested(spark, sf):
    known, fresh = _known_and_new(spark, sf)
    return M.not_yet_ingested(fresh, known).select("batch", "pos", "sha256")


@query(
    "manifest_verdict",
    _M
    + _KNOWN
    + f""", fc AS (SELECT batch, count(*) AS n_files FROM fresh GROUP BY 1),
    w AS (SELECT fresh.*, row_number() OVER (PARTITION BY batch, name ORDER BY pos) AS rn_name,
             row_number() OVER (PARTITION BY batch, sha256 ORDER BY pos) AS rn_sha,
             sum(size) OVER (PARTITION BY batch ORDER BY pos) AS running FROM fresh),
    mixed AS (SELECT batch FROM fresh GROUP BY 1 HAVING count(DISTINCT fmt) > 1),
    v AS (
      SELECT batch, 1 AS stage, pos, CASE WHEN name IS NULL THEN 2 WHEN rn_name > 1 THEN 3 WHEN fmt IS NULL THEN 4 END AS rank,
             CASE WHEN name IS NULL THEN 'invalid_filename' WHEN rn_name > 1 THEN 'duplicate_filename'
                  WHEN fmt IS NULL THEN 'invalid_extension' END AS reason FROM w
      UNION ALL SELECT batch, 2, -1, 5, 'mixed_formats' FROM mixed
      UNION ALL SELECT batch, 3, pos, 6, CASE WHEN size = 0 THEN 'empty_file' WHEN running > {SMALL_BATCH_BYTES} THEN 'batch_too_large'
             WHEN rn_sha > 1 THEN 'duplicate_content' END FROM w
      UNION ALL SELECT batch, 4, pos, 9, 'already_ingested' FROM w WHERE sha256 IN (SELECT sha256 FROM known)),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY stage, pos, rank) AS rn
                         FROM v WHERE reason IS NOT NULL) WHERE rn = 1)
    SELECT fc.batch, n_files, CASE WHEN n_files > 5 THEN 'too_many_files' ELSE reason END AS reject_reason,
           CASE WHEN n_files <= 5 AND pos >= 0 THEN pos END AS at_pos FROM fc LEFT JOIN f USING (batch)""",
)
def manifest_verdict(spark, sf):
    known, fresh = _known_and_new(spark, sf)
    return M.reject_reason(fresh, known, max_bytes=SMALL_BATCH_BYTES)


@query(
    "batch_totals",
    _M + "SELECT batch, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size_bytes FROM m GROUP BY 1",
)
def batch_totals(spark, sf):
    return M.batch_totals(_manifest(spark, sf))


# Header lines of many shapes: the first line of each document, some reshaped.
_HEADERS = """
SELECT doc_id, CASE doc_id % 11
   WHEN 0 THEN ' 1, 2.5 ,1e3,nan' || chr(10) || text
   WHEN 1 THEN 'id,,city' || chr(10) || text
   WHEN 2 THEN 'id, id' || chr(13) || chr(10) || text
   WHEN 3 THEN chr(10) || text
   WHEN 4 THEN 'region,2023,2024' || chr(10) || text
   WHEN 5 THEN 'id,Unnamed: 1'
   WHEN 6 THEN '"a,b",c' || chr(10) || text
   ELSE 'h' || CAST(doc_id AS VARCHAR(20)) || ',' || text END AS text
FROM {documents}
"""


@query(
    "csv_header_check",
    cte(h=_HEADERS)
    + """, l AS (SELECT doc_id, doc_id % 11 AS c, split_part(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), 1) AS line FROM h),
    p AS (SELECT doc_id, c, line, [trim(x) FOR x IN string_split(line, ',')] AS names FROM l)
    SELECT doc_id, CASE c WHEN 0 THEN 'starts_with_data' WHEN 1 THEN 'unnamed_column' WHEN 2 THEN 'repeated_column'
      WHEN 3 THEN 'no_header' WHEN 4 THEN NULL WHEN 5 THEN 'unnamed_column' WHEN 6 THEN NULL
      ELSE CASE WHEN list_contains(names, '') OR len([x FOR x IN names IF starts_with(x, 'Unnamed:')]) > 0 THEN 'unnamed_column'
                WHEN len(list_distinct(names)) < len(names) THEN 'repeated_column' END END AS reject_reason,
      CASE c WHEN 3 THEN 0 WHEN 6 THEN 2 ELSE len(names) END AS n_columns FROM p""",
)
def csv_header_check(spark, sf):
    files = derive(spark, sf, _HEADERS)
    return M.check_csv_headers(files, header_fields(F.col("text"))).select("doc_id", "reject_reason", F.size("names").alias("n_columns"))


_BYTES = """
SELECT doc_id, text, doc_id % 13 = 5 AS broken FROM {documents}
"""


@query("utf8_check", cte(d=_BYTES) + "SELECT doc_id FROM d WHERE broken")
def utf8_check(spark, sf):
    # A lone continuation byte, as a file in another encoding would hold.
    content = F.when(
        F.col("broken"), F.concat(F.col("text").cast("binary"), F.lit(bytearray(b"\xe9")))
    ).otherwise(F.col("text").cast("binary"))
    files = derive(spark, sf, _BYTES).select("doc_id", content.alias("content"))
    return M.check_utf8(files).select("doc_id")
