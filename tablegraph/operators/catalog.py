"""The catalog: what was uploaded, which tables and columns it gave, and the stored rows."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegraph.functions.phrases import is_numeric_type
from tablegraph.operators.positions import ROW_ID
from tablegraph.operators.profile import typed_labels, union_all
from tablegraph.session import work_path

# The states of sessions and jobs, and the formats of files.
SESSION_STATUSES = ["uploading", "queued", "processing", "ready", "failed"]
JOB_STATUSES = ["queued", "processing", "done", "failed"]
DELETABLE_STATUSES = ["ready", "failed"]
HASH_LENGTH = 64


def safe_folder(name: str) -> str:
    """A table name as one folder name; names come from files and must not steer the path."""
    plain = "".join(ch if ch.isalnum() or ch in "-_ " else f"%{ord(ch):02X}" for ch in name)
    return plain or "%00"


def table_path(root: str, session: str, table: str, load: str | None = None) -> str:
    """Where the rows of a table are stored: the same on every run of a load, so a re-run replaces them."""
    version = [] if load is None else [safe_folder(load)]
    return "/".join([root.rstrip("/"), "parsed", safe_folder(str(session)), *version, f"{safe_folder(table)}.parquet"])


def write_table(df: DataFrame, root: str, session: str, table: str, load: str | None = None) -> str | None:
    """Store a table as snappy Parquet, replacing an earlier run; returns its path.

    Rows keep the order of the scan, so each written piece covers a short run
    of ``_row_id`` and a page read skips the others. A table without columns
    has no file.
    """
    if not [name for name in df.columns if name != ROW_ID]:
        return None
    path = table_path(root, session, table, load)
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count"))


def catalog_tables(tables: dict[str, DataFrame], paths: dict[str, str | None] | None = None) -> DataFrame:
    """One row per table: name, row count and path; all counts in one job."""
    paths = paths or {}
    return union_all(
        [
            row_count(df).select(
                F.lit(name).alias("name"), "row_count", F.lit(paths.get(name)).cast("string").alias("parquet_path")
            )
            for name, df in tables.items()
        ]
    )


def catalog_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of typed tables: table, position, name and type label."""
    return union_all(
        [
            typed_labels(df, [c for c in df.columns if c != ROW_ID]).select(
                F.lit(name).alias("table"), "position", "name", "inferred_type"
            )
            for name, df in tables.items()
        ]
    )


def replace_session(catalog: DataFrame, new: DataFrame, sessions: DataFrame) -> DataFrame:
    """The catalog with the listed sessions' rows replaced by the new ones.

    A session that is listed but has no new rows loses its old ones.
    """
    kept = catalog.join(sessions.select("session_id").distinct(), "session_id", "left_anti")
    return kept.unionByName(new)


def delete_session(
    sessions: DataFrame, children: dict[str, DataFrame], ids: DataFrame
) -> dict[str, DataFrame]:
    """Remove finished sessions and everything that hangs off them.

    Only sessions that are ready or failed may go; a listed session that is
    still being worked on stays with all its rows.
    """
    finished = sessions.where(F.col("status").isin(DELETABLE_STATUSES)).select("session_id")
    gone = ids.select("session_id").distinct().join(finished, "session_id", "left_semi")
    return {
        name: df.join(gone, "session_id", "left_anti")
        for name, df in {"sessions": sessions, **children}.items()
    }


def session_list(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Every session with its files, one row per file, null for a session without any."""
    names = files.select("session_id", F.col("filename"))
    return sessions.join(names, "session_id", "left")


def with_file_names(page: DataFrame, files: DataFrame) -> DataFrame:
    """A page of sessions with their file names as a list, for display.

    Meant for the rows of ``session_page``. Intake allows a handful of files
    per session, so the lists are short.
    """
    listed = (
        files.join(F.broadcast(page.select("session_id")), "session_id", "left_semi")
        .groupBy("session_id")
        .agg(F.sort_array(F.collect_list("filename")).alias("filenames"))
    )
    return page.join(listed, "session_id", "left").withColumn(
        "filenames", F.coalesce("filenames", F.array().cast("array<string>"))
    )


def table_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Every table with its columns, one row per column, null for a table without any."""
    return tables.join(columns.select("table_id", "position", F.col("name").alias("column"), "inferred_type"), "table_id", "left")


def table_listing(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Every table with its columns as a list in position order.

    The list is a table's own header, which any reader of the table holds anyway.
    """
    listed = columns.groupBy("table_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "name", "inferred_type"))).alias("columns")
    )
    return tables.join(listed, "table_id", "left")


def lookup(requested: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Requested ids with their records and whether each exists."""
    known = records.withColumn("_found", F.lit(True))
    return (
        requested.join(known, key, "left")
        .withColumn("found", F.coalesce("_found", F.lit(False)))
        .drop("_found")
    )


def get_table(tables: DataFrame, requested: DataFrame) -> DataFrame:
    """Tables by id; an unknown id stays, marked as not found."""
    return lookup(requested.select("table_id"), tables, "table_id")


def list_tables(sessions: DataFrame, tables: DataFrame, requested: DataFrame) -> DataFrame:
    """Tables of the requested sessions.

    A session that exists but has no tables gives one row with a null table; an
    unknown session gives one row marked as not found.
    """
    return lookup(requested.select("session_id"), sessions.select("session_id"), "session_id").join(
        tables, "session_id", "left"
    )


def numeric_columns(columns: DataFrame) -> DataFrame:
    """Columns whose type label reads as a number."""
    return columns.where(is_numeric_type(F.col("inferred_type")))


def _violations(df: DataFrame, rule: str, broken: Column, subject: Column) -> DataFrame:
    return df.where(broken).select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))


def _repeats(df: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, counted with a combine before the shuffle."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select(F.lit(rule).alias("rule"), F.concat_ws("/", *keys).alias("subject"))
    )


def audit_catalog(
    sessions: DataFrame | None = None,
    files: DataFrame | None = None,
    tables: DataFrame | None = None,
    columns: DataFrame | None = None,
    jobs: DataFrame | None = None,
) -> DataFrame:
    """Rows of the catalog that break one of its rules: the rule and what breaks it."""
    found: list[DataFrame] = []
    if sessions is not None:
        own = F.col("session_id")
        found += [
            _violations(sessions, "session_without_files", F.col("total_files") <= 0, own),
            _violations(sessions, "session_without_bytes", F.col("total_size_bytes") <= 0, own),
            _violations(sessions, "session_status", ~F.col("status").isin(SESSION_STATUSES), own),
        ]
    if files is not None:
        own = F.concat_ws("/", "session_id", "filename")
        found += [
            _repeats(files, "file_hash_repeated", ["sha256"]),
            _repeats(files, "file_name_repeated", ["session_id", "filename"]),
            _violations(files, "file_empty", F.col("size") <= 0, own),
            _violations(files, "file_hash_length", F.length("sha256") != HASH_LENGTH, own),
        ]
    if tables is not None:
        found += [
            _repeats(tables, "table_name_repeated", ["session_id", "name"]),
            _violations(tables, "table_row_count", F.col("row_count") < 0, F.col("table_id")),
        ]
    if columns is not None:
        found.append(_repeats(columns, "column_name_repeated", ["table_id", "name"]))
    if jobs is not None:
        found += [
            _violations(jobs, "job_attempts", F.col("attempt_count") < 0, F.col("job_id")),
            _violations(jobs, "job_status", ~F.col("status").isin(JOB_STATUSES), F.col("job_id")),
        ]
    return union_all(found)


# The described tables of stored loads, each partitioned by ``load``.
CATALOG_SCHEMAS: dict[str, dict[str, str]] = {
    "tables": {"session_id": "string", "table_id": "string", "name": "string", "row_count": "bigint", "parquet_path": "string"},
    "columns": {
        "session_id": "string", "table_id": "string", "table": "string", "position": "int", "name": "string",
        "inferred_type": "string", "stored_type": "string",
    },
    "links": {
        "session_id": "string", "from_table": "string", "to_table": "string", "type": "string", "from_column": "string",
        "to_column": "string", "name": "string", "inverse_name": "string",
    },
}
_COMMITS = "session_id string, seq bigint, deleted boolean, load string"


def table_id(session_id: Column, name: Column) -> Column:
    """The id of a table: the same whenever and wherever its session is loaded."""
    return F.md5(F.concat(session_id, F.lit("\0"), name))


def _schema(name: str) -> str | None:
    fields = CATALOG_SCHEMAS.get(name)
    return fields and ", ".join(f"`{field}` {kind}" for field, kind in fields.items()) + ", load string"


def write_catalog(df: DataFrame, root: str, name: str, partition: str) -> str:
    """Add rows to a catalog table, replacing the partitions they belong to.

    Partitioned by load (or by micro-batch), so a repeated load replaces its
    own rows and no others.
    """
    path = f"{root.rstrip('/')}/catalog/{name}"
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )
    return path


def _existing(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table stored at a path, None when nothing is."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def commit(sessions: DataFrame, root: str, load: str, deleted: bool = False) -> None:
    """Make ``load`` what the given sessions consist of, or take them away; readers see all of it or nothing.

    Called when all rows and descriptions of a load are written. The latest commit of a session counts; a repeated
    commit of a load replaces itself.
    """
    now = F.lit(time.time_ns() // 1000).alias("seq")
    rows = sessions.select("session_id", now, F.lit(deleted).alias("deleted"), F.lit(load).alias("load"))
    write_catalog(rows, root, "commits", "load")


def current_loads(spark: SparkSession, root: str) -> DataFrame | None:
    """(session_id, load) of the sessions that are there; None before the first commit."""
    commits = _existing(spark, f"{root.rstrip('/')}/catalog/commits", _COMMITS)
    if commits is None:
        return None
    latest = commits.groupBy("session_id").agg(F.max(F.struct("seq", "load", "deleted")).alias("last"))
    return latest.where("not last.deleted").select("session_id", F.col("last.load").alias("load"))


def read_catalog(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """A catalog table; with a schema the types of its partition columns are not guessed.

    Of tables, columns and links only what the latest load of each session wrote.
    """
    path = f"{root.rstrip('/')}/catalog/{name}"
    if name not in CATALOG_SCHEMAS:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    stored = _existing(spark, path, _schema(name))
    if stored is None:
        return spark.createDataFrame([], _schema(name))
    current = current_loads(spark, root)
    return stored if current is None else stored.join(current, ["session_id", "load"], "left_semi").select(*stored.columns)


def sweep(spark: SparkSession, root: str) -> None:
    """Remove what no current session holds: rows, descriptions and the folders of replaced tables. Safe to repeat.

    A load of which nothing is current goes as a folder; one shared with other sessions is written again without the
    others. Only names of loads and of tables to remove come to the driver.
    """
    root = root.rstrip("/")
    current = current_loads(spark, root)
    if current is None:
        return
    current = current.withColumn("held", F.lit(True))
    tables = _existing(spark, f"{root}/catalog/tables", _schema("tables"))
    if tables is not None:
        own = tables.where(F.col("parquet_path").startswith(f"{root}/parsed/"))
        held = own.join(current, ["session_id", "load"], "left_semi").select("parquet_path")
        for row in own.select("parquet_path").distinct().join(held, "parquet_path", "left_anti").toLocalIterator():
            _remove(spark, row["parquet_path"])
    rows = "session_id string, `table` string, _row_id bigint, cells map<string,string>, load string"
    for place, schema in [("rows", rows), *[(f"catalog/{name}", _schema(name)) for name in ("links", "columns", "tables")]]:
        stored = _existing(spark, f"{root}/{place}", schema)
        if stored is None:
            continue
        marked = stored.select("session_id", "load").distinct().join(current, ["session_id", "load"], "left")
        loads = marked.groupBy("load").agg(F.count("held").alias("held"), F.count("*").alias("all")).where("held < all").collect()
        shared = [row["load"] for row in loads if row["held"]]
        if shared:
            stage = work_path(spark, "swept")
            kept = stored.where(F.col("load").isin(shared)).join(current, ["session_id", "load"], "left_semi")
            kept.select(*stored.columns).write.parquet(stage)
            again = spark.read.schema(schema).parquet(stage)
            again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(f"{root}/{place}")
        for row in loads:
            if not row["held"]:
                _remove(spark, f"{root}/{place}/load={_escaped(spark, row['load'])}")


def _escaped(spark: SparkSession, value: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it; one that is gone already is fine."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def delete_stored(sessions: DataFrame, root: str, ids: DataFrame) -> DataFrame:
    """Delete finished sessions from storage and return those that went; a repeated call ends what a first one began.

    First a commit takes them from every reader's sight, then their rows and descriptions go. The caller drops their
    records last, so that a failure between leaves nothing that could not be found again.
    """
    spark = sessions.sparkSession
    finished = sessions.where(F.col("status").isin(DELETABLE_STATUSES)).select("session_id")
    stage = work_path(spark, "deleted")
    ids.select("session_id").distinct().join(finished, "session_id", "left_semi").write.parquet(stage)
    gone = spark.read.schema("session_id string").parquet(stage)
    commit(gone, root, f"delete-{uuid.uuid4().hex}", deleted=True)
    sweep(spark, root)
    return gone
