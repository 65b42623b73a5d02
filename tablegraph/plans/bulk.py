"""Many uploads at once: their files become rows of one store, described by grouping on session and table.

Meant for uploads within the intake limits, whose files each fit one row. Every format is one plan over all files of
that format, so the number of jobs depends neither on uploads nor on tables, and a file that breaks a rule of its
format is a row of faults that fails its own upload alone. Rows keep their values as text by column name; the
catalog holds the type of each column, and ``stored_table`` reads a table under its own columns and types.
"""

from __future__ import annotations

import base64
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegraph.functions.text import quoted
from tablegraph.operators.catalog import CATALOG_SCHEMAS, read_catalog, table_id
from tablegraph.operators.links import dedupe_links
from tablegraph.operators.manifest import check_csv_headers
from tablegraph.operators.positions import ROW_ID
from tablegraph.operators.profile import NA_TOKENS, STORED_TYPES, inferred_type, seen_classes
from tablegraph.session import work_path
from tablegraph.sources import dump as D
from tablegraph.sources import json as J
from tablegraph.sources.csv import csv_fields, header_fields
from tablegraph.sources.listing import stem

ROWS_SCHEMA = f"session_id string, table string, {ROW_ID} bigint, cells map<string,string>"
COLUMNS_SCHEMA = "session_id string, table string, position int, name string, inferred_type string, stored_type string"
FAULTS_SCHEMA = "session_id string, error string"

#: Separates session and table where both make one key; no file name holds it.
_MARK = "\0"


@dataclass(frozen=True)
class Parsed:
    """What the files of one format hold: tables, their columns, rows and links, and what can't be read."""

    tables: DataFrame
    columns: DataFrame
    rows: DataFrame
    faults: DataFrame
    links: DataFrame | None = None


def _fault(df: DataFrame, reason: Column | str) -> DataFrame:
    said = F.lit(reason) if isinstance(reason, str) else reason
    return df.select("session_id", F.concat(F.col("filename"), F.lit(": "), said).alias("error"))


# --- CSV -----------------------------------------------------------------------

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+|[^,\r\n]*+)'
_RECORD = rf"(?=[^\r\n]){_FIELD}(?:,{_FIELD})*+"


def parse_csv(files: DataFrame) -> Parsed:
    """Files with ``session_id``, ``name``, ``filename`` and ``text``: records with line ends in quotes, header
    rules, surplus fields as faults, missing values, and types over all rows of each table."""
    spark = files.sparkSession
    plain = F.regexp_replace("text", "^﻿", "")
    records = F.filter(F.regexp_extract_all(plain, F.lit(_RECORD), F.lit(0)), lambda r: ~r.rlike(r"^[\x00-\x20]+$"))
    headed = check_csv_headers(files, header_fields(F.col("text"))).withColumnRenamed("reject_reason", "reason")
    stage = work_path(spark, "bulk_csv")
    headed.select("session_id", "filename", F.col("name").alias("table"), "names", "reason").write.parquet(f"{stage}/headers")
    headers = spark.read.parquet(f"{stage}/headers")
    fine = headed.where("reason is null").select(
        "session_id", "filename", F.col("name").alias("table"), "names", F.posexplode(F.slice(records, 2, 1 << 30)).alias("pos", "record")
    )
    fields = fine.withColumn("fields", csv_fields(F.col("record"))).drop("record")
    n = F.size("names")
    surplus = (F.size("fields") > n) & F.exists(F.slice("fields", n + 1, F.greatest(F.size("fields") - n, F.lit(1))), lambda f: f != "")
    values = F.transform("names", lambda _, i: F.get("fields", i))
    values = F.transform(values, lambda v: F.when(~v.isin(NA_TOKENS), v))
    fields.select("session_id", "filename", "table", "pos", "names", values.alias("values"), surplus.alias("surplus")).write.parquet(
        f"{stage}/rows"
    )
    rows = spark.read.parquet(f"{stage}/rows")
    ragged = rows.where("surplus").groupBy("session_id", "filename").agg(F.count("*").alias("n"))
    faults = _fault(headers.where("reason is not null"), F.col("reason")).unionByName(
        _fault(ragged, F.concat(F.col("n").cast("string"), F.lit(" rows have more fields than the header")))
    )
    sound = headers.where("reason is null")
    listed = sound.select("session_id", "table", F.posexplode("names").alias("position", "name"))
    seen = seen_classes(
        rows.select("session_id", "table", F.posexplode("values").alias("position", "value")), ["session_id", "table", "position"]
    )
    label = F.coalesce(inferred_type(F.col("fact")), F.lit("object"))
    kinds = F.create_map(*[F.lit(part) for pair in STORED_TYPES.items() for part in pair])
    described = listed.join(seen, ["session_id", "table", "position"], "left").withColumn("inferred_type", label)
    return Parsed(
        sound.select("session_id", "table"),
        described.select("session_id", "table", "position", "name", "inferred_type", F.element_at(kinds, F.col("inferred_type")).alias("stored_type")),
        rows.select("session_id", "table", F.col("pos").cast("bigint").alias(ROW_ID), F.map_from_arrays("names", "values").alias("cells")),
        faults,
    )


# --- JSON ----------------------------------------------------------------------


def parse_json(files: DataFrame) -> Parsed:
    """Record sets of all documents, described by table and flattened into dotted columns."""
    spark = files.sparkSession
    docs = files.select("session_id", "filename", F.concat("session_id", F.lit(_MARK), "name").alias("name"), F.col("text").alias("doc"))
    own = F.split_part("name", F.lit(_MARK), F.lit(1)).alias("session_id")
    stage = work_path(spark, "bulk_json")
    # The table of a root array or object is its file's, which carries the session; a key's is the key.
    table = F.when(F.col("table") == F.col("name"), F.split_part("name", F.lit(_MARK), F.lit(2))).otherwise(F.col("table"))
    J.json_record_sets(docs.select("name", "doc"), strict=False).select(own, "name", table.alias("table"), "pos", "record").write.parquet(
        f"{stage}/records"
    )
    records = spark.read.parquet(f"{stage}/records")
    broken = docs.withColumn("reason", J.document_fault(F.col("doc"))).where("reason is not null")
    named = records.groupBy("session_id", "table").agg(F.count_distinct("name").alias("n"))
    twice = named.where("n > 1").select("session_id", F.col("table").alias("filename"))
    faults = _fault(broken, F.col("reason")).unionByName(_fault(twice, "named by more than one file"))
    keyed = records.where("record is not null").select(
        F.concat("session_id", F.lit(_MARK), "table").alias("table"), "pos", "record"
    )
    split = [F.split_part("table", F.lit(_MARK), F.lit(k)).alias(name) for k, name in ((1, "session_id"), (2, "table"))]
    kinds = F.create_map(*[F.lit(part) for pair in J.STORED_TYPES.items() for part in pair])
    # Records of a table that two files of an upload name have no order between them.
    unclear = twice.select(F.concat("session_id", F.lit(_MARK), "filename").alias("table"))
    described = J.describe_records(keyed.join(unclear, "table", "left_anti"))
    # The place of a path in its record is a list of numbers, so columns are put in order by table: as many as it has.
    ordered = described.groupBy("table").agg(F.sort_array(F.collect_list(F.struct("first", "path", "inferred_type"))).alias("all"))
    columns = ordered.select(*split, F.posexplode("all").alias("position", "c")).select(
        "session_id", "table", "position", F.col("c.path").alias("name"), F.col("c.inferred_type").alias("inferred_type"),
        F.element_at(kinds, F.col("c.inferred_type")).alias("stored_type"),
    )
    flat = J.flatten_entries(keyed)
    cells = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["path"], e["value"])))
    rows = flat.select(*split, F.col("pos").cast("bigint").alias(ROW_ID), cells.alias("cells"))
    return Parsed(named.select("session_id", "table"), columns, rows, faults)


# --- SQL dumps -----------------------------------------------------------------


def parse_sql(files: DataFrame) -> Parsed:
    """Statements of all uploads, each under its own session, so that no upload sees the tables of another."""
    spark = files.sparkSession
    stage = work_path(spark, "bulk_sql")
    pieces = files.select(F.col("text").alias("value"), F.concat_ws(_MARK, "session_id", "filename").alias("_file"), F.lit(0).cast("bigint").alias("_block"))
    stmts = D.numbered_statements(pieces, stage)
    session = F.split_part("file", F.lit(_MARK), F.lit(1))
    stmts = stmts.withColumn("target", F.concat(session, F.lit(_MARK), "target"))
    split = [F.split_part("table", F.lit(_MARK), F.lit(k)).alias(name) for k, name in ((1, "session_id"), (2, "table"))]
    declared = D.dump_columns(stmts)
    D.numbered_cells(stmts, names=True).write.parquet(f"{stage}/rows")
    rows = spark.read.parquet(f"{stage}/rows")
    kinds = D.cell_kinds(rows)
    typed = declared.join(kinds, ["table", "position"], "left").withColumn("stored_type", D.stored_type_of("kinds", "digits"))
    cells = F.map_from_arrays("names", F.transform("cells", lambda c: c["value"]))
    links = dedupe_links(D.dump_links(stmts), ["stmt_no", "item_no"])
    parts = [F.split_part("from_table", F.lit(_MARK), F.lit(k)).alias(name) for k, name in ((1, "session_id"), (2, "from_table"))]
    return Parsed(
        stmts.where("kind = 'create'").select(F.col("target").alias("table")).distinct().select(*split),
        typed.select(*split, "position", "name", "inferred_type", "stored_type"),
        rows.select(*split, ROW_ID, cells.alias("cells")),
        spark.createDataFrame([], FAULTS_SCHEMA),
        links.select(*parts, *[quoted(c) for c in links.columns if c != "from_table"]),
    )


# --- Parquet -------------------------------------------------------------------

_LABELS = {pa.int8(): ("int8", "tinyint"), pa.int16(): ("int16", "smallint"), pa.int32(): ("int32", "int"), pa.int64(): ("int64", "bigint"),
           pa.float32(): ("float32", "float"), pa.float64(): ("float64", "double"), pa.bool_(): ("bool", "boolean")}


def _described(field: pa.Field, gaps: bool) -> tuple[str, str]:
    """Label and Spark type of a column; a whole number or boolean with gaps is labelled as what holds it."""
    kind = field.type
    if kind in _LABELS:
        label, stored = _LABELS[kind]
        return ("float64" if gaps and label.startswith("int") else "object" if gaps and label == "bool" else label), stored
    if pa.types.is_timestamp(kind):
        return ("datetime64[us]", "timestamp_ntz") if kind.tz is None else ("datetime64[us, UTC]", "timestamp")
    if pa.types.is_decimal(kind) and kind.precision <= 38:
        return "object", f"decimal({kind.precision},{kind.scale})"
    return ("object", "date") if pa.types.is_date(kind) else ("object", "string")


def _texts(column: pa.ChunkedArray) -> list[str | None]:
    """Values as texts that cast back to the same value; nested ones as JSON, bytes in base64."""
    kind = column.type
    if pa.types.is_timestamp(kind) and kind.tz is not None:
        column = column.cast(pa.timestamp("us", "UTC")).cast(pa.timestamp("us"))
    elif pa.types.is_dictionary(kind):
        return _texts(column.cast(kind.value_type))
    elif pa.types.is_nested(kind):
        return [None if v is None else json.dumps(v, default=str, ensure_ascii=False) for v in column.to_pylist()]
    elif pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return [None if v is None else base64.b64encode(v).decode() for v in column.to_pylist()]
    return column.cast(pa.string()).to_pylist()


def _open_parquet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, columns and faults of Parquet files given as bytes, told apart by ``what``."""
    cells = pa.map_(pa.string(), pa.string())

    def out(what: str, session: str, table: str, pos: list, cell: list, name=None, label=None, stored=None):
        n = len(pos)
        constant = lambda v: pa.array([v] * n, pa.string())
        listed = lambda v: pa.array(v if v is not None else [None] * n, pa.string())
        arrays = [constant(what), constant(session), constant(table), pa.array(pos, pa.int64()), pa.array(cell, cells),
                  listed(name), listed(label), listed(stored)]
        return pa.RecordBatch.from_arrays(arrays, ["what", "session_id", "table", "pos", "cells", "name", "label", "stored"])

    for rows in batches:
        for k in range(rows.num_rows):
            session, table, content = (rows.column(c)[k] for c in ("session_id", "name", "content"))
            session, table = session.as_py(), table.as_py()
            try:
                data = pq.read_table(io.BytesIO(content.as_buffer()))
            except (pa.ArrowException, OSError, ValueError) as error:  # the file's own fault, and no other's
                yield out("fault", session, table, [0], [None], name=[str(error)[:500]])
                continue
            names = data.column_names
            told = [_described(field, data.column(i).null_count > 0) for i, field in enumerate(data.schema)]
            if len(set(names)) < len(names):
                yield out("fault", session, table, [0], [None], name=["repeated column"])
                continue
            yield out("column", session, table, list(range(len(names))), [None] * len(names), names, [a for a, _ in told], [b for _, b in told])
            yield out("table", session, table, [0], [None])
            for at in range(0, data.num_rows, 4096):
                part = data.slice(at, 4096)
                columns = [_texts(column) for column in part.columns]
                cell = [list(zip(names, values, strict=True)) for values in zip(*columns, strict=True)] or [[]] * part.num_rows
                yield out("row", session, table, list(range(at, at + part.num_rows)), cell)


def parse_parquet(files: DataFrame) -> Parsed:
    """Parquet files opened inside the tasks: each has its own schema, and a broken one is told as a fault."""
    spark = files.sparkSession
    stage = work_path(spark, "bulk_parquet")
    schema = "what string, session_id string, table string, pos bigint, cells map<string,string>, name string, label string, stored string"
    files.select("session_id", "name", "content").mapInArrow(_open_parquet, schema).write.partitionBy("what").parquet(stage)
    read = spark.read.schema(schema).parquet(stage)
    rows, columns, faults, tables = (read.where(F.col("what") == what) for what in ("row", "column", "fault", "table"))
    return Parsed(
        tables.select("session_id", "table"),
        columns.select("session_id", "table", F.col("pos").cast("int").alias("position"), "name", F.col("label").alias("inferred_type"), F.col("stored").alias("stored_type")),
        rows.select("session_id", "table", F.col("pos").alias(ROW_ID), "cells"),
        faults.select("session_id", F.concat("table", F.lit(": "), "name").alias("error")),
    )


# --- All formats ---------------------------------------------------------------

PARSERS = {"csv": parse_csv, "json": parse_json, "sql": parse_sql, "parquet": parse_parquet}


def _rejoined(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def load_uploads(files: DataFrame, out: str, load: str) -> DataFrame:
    """Parse, store and describe uploads; returns the faults: one row per upload that can't be read.

    ``files``: ``session_id``, ``format``, ``filename`` (safe) and ``content``. Rows come before their description,
    and only of uploads without a fault. What an earlier run of the same ``load`` left is replaced.
    """
    spark = files.sparkSession
    stage = work_path(spark, "bulk")
    named = files.withColumn("name", stem(F.col("filename")))
    text = F.is_valid_utf8(F.col("content"))
    # Text files that are no text fail before any parser sees them.
    textual = named.where("format <> 'parquet'")
    binary = _fault(textual.where(~text), "not valid UTF-8")
    decoded = textual.where(text).withColumn("text", F.col("content").cast("string")).drop("content")
    # At most one row per format.
    present = {row["format"] for row in files.select("format").distinct().collect()} & set(PARSERS)
    parsed = [
        PARSERS[fmt]((decoded if fmt != "parquet" else named).where(F.col("format") == fmt)) for fmt in sorted(present)
    ]
    if not parsed:
        return spark.createDataFrame([], FAULTS_SCHEMA)
    faults = _rejoined([binary, *[p.faults for p in parsed]]).groupBy("session_id").agg(
        F.array_join(F.slice(F.sort_array(F.collect_set("error")), 1, 5), "; ").alias("error")
    )
    faults.write.parquet(f"{stage}/faults")
    faults = spark.read.schema(FAULTS_SCHEMA).parquet(f"{stage}/faults")
    sound = lambda df: df.join(faults, "session_id", "left_anti")
    mark = F.lit(load).alias("load")

    rows = sound(_rejoined([p.rows.select("session_id", "table", ROW_ID, "cells") for p in parsed]))
    place = f"{out.rstrip('/')}/rows"
    # Rows of a table lie together, so that reading one skips the files and row groups of others.
    rows = rows.select("*", mark).repartitionByRange("session_id", "table", ROW_ID).sortWithinPartitions("session_id", "table", ROW_ID)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(place)
    stored = spark.read.schema(f"{ROWS_SCHEMA}, load string").parquet(place).where(F.col("load") == load)
    counts = stored.groupBy("session_id", "table").agg(F.count("*").alias("row_count"))
    tables = sound(_rejoined([p.tables for p in parsed])).join(counts, ["session_id", "table"], "left")
    own = table_id(F.col("session_id"), F.col("table")).alias("table_id")
    described = {
        "tables": tables.select("session_id", own, F.col("table").alias("name"), F.coalesce("row_count", F.lit(0)).cast("bigint").alias("row_count"), F.lit(place).alias("parquet_path"), mark),
        "columns": sound(_rejoined([p.columns.select("session_id", "table", "position", "name", "inferred_type", "stored_type") for p in parsed])).select("session_id", own, "table", "position", "name", "inferred_type", "stored_type", mark),
    }
    links = [p.links for p in parsed if p.links is not None]
    if links:
        described["links"] = sound(_rejoined(links)).select("*", mark)
    for name, df in described.items():
        path = f"{out.rstrip('/')}/catalog/{name}"
        fields = [F.col(f"`{c}`") for c in CATALOG_SCHEMAS[name]]
        df.select(*fields, "load").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(path)
    return faults


def stored_table(spark: SparkSession, out: str, session_id: str, name: str) -> DataFrame:
    """One table of the row store under its own columns and types, with ``_row_id``."""
    own = (F.col("session_id") == session_id) & (F.col("table") == name)
    columns = read_catalog(spark, out, "columns").where(own).orderBy("position").collect()
    load = columns[0]["load"] if columns else None
    rows = spark.read.schema(f"{ROWS_SCHEMA}, load string").parquet(f"{out.rstrip('/')}/rows").where(own & F.col("load").eqNullSafe(F.lit(load)))
    typed = []
    for column in columns:
        value = F.try_element_at("cells", F.lit(column["name"]))
        if column["stored_type"] == "boolean":
            value = F.lower(value)
        elif column["stored_type"] in ("bigint", "double"):  # JSON columns of numbers may hold booleans, as 1 and 0
            value = F.when(value == "true", "1").when(value == "false", "0").otherwise(F.trim(value))
        typed.append(value.cast(column["stored_type"]).alias(column["name"]))
    return rows.select(*typed, ROW_ID)
