"""A landing folder as a stream: every new upload is checked, parsed and recorded.

An upload is a folder ``<landing>/<session>/<files>``, moved into place whole, and
taken up whole: a micro-batch is everything that has landed since the last one.
An upload that can't be read fails alone, with the reason on its session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablegraph.functions.filenames import format_of, safe_filename
from tablegraph.operators.catalog import commit, read_catalog, write_catalog
from tablegraph.operators.manifest import MAX_BATCH_BYTES, batch_totals, hashed, reject_reason
from tablegraph.plans.bulk import load_uploads
from tablegraph.session import work_path

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"

#: Fixed value: the reason of an upload whose files broke a rule of their format.
UNREADABLE = "unreadable"

MANIFEST_SCHEMA = (
    "batch string, pos string, filename string, path string, size bigint, sha256 string, arrived timestamp, "
    "batch_id bigint"
)
SESSIONS_SCHEMA = (
    "session_id string, format string, total_files bigint, total_size_bytes bigint, status string, "
    "reject_reason string, error string, folder string, created_at timestamp, batch_id bigint"
)


def landed_manifest(files: DataFrame) -> DataFrame:
    """Manifest rows from landed files: the upload folder is the batch, names give the order."""
    own = F.regexp_extract("path", r"([^/]+)$", 1)
    return hashed(files).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("batch"),
        own.alias("pos"),
        own.alias("filename"),
        "path",
        "size",
        "sha256",
        F.col("modificationTime").alias("arrived"),
    )


def late_copies(m: DataFrame) -> DataFrame:
    """Uploads of a manifest that hold bytes of an accepted upload which arrived earlier.

    Uploads are settled in order of arrival, then name: an upload whose bytes are
    all first there is accepted and refuses the others that hold them, until
    none is left. Only bytes that several uploads share are looked at.
    """
    spark = m.sparkSession
    place = F.max("arrived").alias("arrived")
    order = m.groupBy("batch").agg(place).select("batch", F.struct("arrived", "batch").alias("place"))
    shared = m.where("sha256 is not null").groupBy("sha256").agg(F.countDistinct("batch").alias("n")).where("n > 1")
    claims = m.join(shared, "sha256", "left_semi").select("batch", "sha256").distinct().join(order, "batch")
    stage = work_path(spark, "claims")
    refused = spark.createDataFrame([], "batch string")
    turn = 0
    claims.write.parquet(f"{stage}/open-0")
    while not (claims := spark.read.parquet(f"{stage}/open-{turn}")).isEmpty():
        owners = claims.groupBy("sha256").agg(F.min("place").alias("first"))
        first = claims.join(owners, "sha256").groupBy("batch").agg(F.min(F.col("place") == F.col("first")).alias("all"))
        accepted = first.where("all").select("batch")
        taken = claims.join(accepted, "batch", "left_semi").select("sha256").distinct()
        lost = claims.join(accepted, "batch", "left_anti").join(taken, "sha256", "left_semi").select("batch").distinct()
        lost.write.parquet(f"{stage}/lost-{turn}")
        lost = spark.read.parquet(f"{stage}/lost-{turn}")
        refused = refused.unionByName(lost)
        rest = claims.join(accepted, "batch", "left_anti").join(lost, "batch", "left_anti")
        turn += 1
        rest.write.parquet(f"{stage}/open-{turn}")
    return refused


def take_uploads(files: DataFrame, out: str, batch_id: int) -> None:
    """Check, parse and record the uploads of one micro-batch; safe to run twice."""
    spark = files.sparkSession
    number = F.lit(batch_id).cast("bigint").alias("batch_id")
    # Hashed once: the manifest is stored and every later step reads it back.
    write_catalog(landed_manifest(files).select("*", number), out, "manifest", "batch_id")
    everything = read_catalog(spark, out, "manifest", MANIFEST_SCHEMA)
    m = everything.where(F.col("batch_id") == batch_id).drop("batch_id")

    known = everything.where(F.col("batch_id") < batch_id)
    if batch_id > 0:
        earlier = read_catalog(spark, out, "sessions", SESSIONS_SCHEMA)
        taken = earlier.where((F.col("batch_id") < batch_id) & (F.col("status") == "ready"))
        known = known.join(taken.select(F.col("session_id").alias("batch")), "batch", "left_semi")

    shape = m.groupBy("batch").agg(
        F.min(format_of(safe_filename(F.col("filename")))).alias("format"),
        F.min(F.regexp_replace("path", r"/[^/]+$", "")).alias("folder"),
        F.max("arrived").alias("created_at"),
    )
    checked = reject_reason(m, known).select("batch", "reject_reason")
    fine = m.join(checked.where("reject_reason is null"), "batch", "left_semi")
    late = late_copies(fine).withColumn("late", F.lit(True))
    reason = F.coalesce("reject_reason", F.when(F.col("late"), "already_ingested"))
    sessions = (
        checked.join(late, "batch", "left")
        .withColumn("reject_reason", reason)
        .join(batch_totals(m), "batch")
        .join(shape, "batch")
        .select(F.col("batch").alias("session_id"), "format", "total_files", "total_size_bytes", "reject_reason", "folder", "created_at")
    )
    accepted = work_path(spark, "accepted")
    sessions.write.parquet(accepted)
    sessions = spark.read.schema(sessions.schema).parquet(accepted)
    fine = sessions.where("reject_reason is null").select("session_id", "format")
    # The files of all accepted uploads, whatever their number, in one plan per format.
    batch = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    contents = files.where(F.col("length") <= MAX_BATCH_BYTES).select(
        batch.alias("session_id"), safe_filename(F.regexp_extract("path", r"([^/]+)$", 1)).alias("filename"), "content"
    )
    load = f"batch-{batch_id}"
    faults = load_uploads(contents.join(fine, "session_id"), out, load)
    settled = sessions.join(faults.withColumn("broken", F.lit(UNREADABLE)), "session_id", "left").withColumn(
        "reject_reason", F.coalesce("reject_reason", "broken")
    )
    commit(fine.join(faults, "session_id", "left_anti"), out, load)
    status = F.when(F.col("reject_reason").isNull(), "ready").otherwise("failed").alias("status")
    write_catalog(
        settled.select(
            "session_id", "format", "total_files", "total_size_bytes", status, "reject_reason", "error", "folder",
            "created_at", number,
        ),
        out,
        "sessions",
        "batch_id",
    )


def ingest_stream(spark: SparkSession, landing: str, out: str, checkpoint: str) -> StreamingQuery:
    """Take up whatever has landed since the last run, then stop.

    The checkpoint remembers which files were taken; a micro-batch that is
    repeated after a failure overwrites its own tables and catalog rows.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .load(landing)
    )
    return (
        files.writeStream.foreachBatch(lambda batch, batch_id: take_uploads(batch, out, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
