"""Streaming queries: the events replayed as messages, the customers as landed uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegraph.operators.catalog import read_catalog
from tablegraph.session import work_path
from tablegraph.streaming import landing as N
from tablegraph.streaming import messages as S
from tablegraph.workload.data import query, table


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return (
        spark.readStream.schema(table(spark, sf, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
    )


# Identifiers are the event and user numbers in the last digits of a UUID.
_UUID = "'00000000-0000-0000-0000-' || lpad(CAST({0} AS VARCHAR(20)), 12, '0')"
_JOB_ID = _UUID.format("event_id")
_SESSION_ID = _UUID.format("user_id")
_BODY = f"""CASE event_type
  WHEN 'view' THEN '{{"job_id":"' || {_JOB_ID} || '","session_id":"' || {_SESSION_ID} || '"}}'
  WHEN 'error' THEN 'not json ' || CAST(event_id AS VARCHAR(20))
  WHEN 'click' THEN '{{"job_id":"' || CAST(event_id AS VARCHAR(20)) || '","session_id":"' || {_SESSION_ID} || '"}}'
  WHEN 'signup' THEN '{{"session_id":"' || {_SESSION_ID} || '","attempt":1}}'
  ELSE '{{"job_id":"' || {_JOB_ID} || '","session_id":"' || {_SESSION_ID} || '","attempt":' || CAST(event_id % 3 AS VARCHAR(9)) || '}}' END
""".replace("{{", "{").replace("}}", "}")


@query(
    "stream_dead_letter",
    f"""SELECT {_JOB_ID} AS job_id, {_SESSION_ID} AS session_id, CASE event_type WHEN 'view' THEN 0 ELSE event_id % 3 END AS attempt,
         CAST(NULL AS VARCHAR) AS body FROM events WHERE event_type IN ('view', 'purchase')
       UNION ALL SELECT NULL, NULL, NULL, {_BODY} FROM events WHERE event_type IN ('error', 'click', 'signup')""",
)
def stream_dead_letter(spark, sf):
    bodies = _event_stream(spark, sf).select(F.expr(_BODY).cast("binary").alias("value"))
    out = work_path(spark, "messages")
    S.route_messages(bodies, f"{out}/jobs", f"{out}/dead", f"{out}/checkpoint").awaitTermination()
    good = spark.read.parquet(f"{out}/jobs").select(
        "job_id", "session_id", "attempt", F.lit(None).cast("string").alias("body")
    )
    dead = spark.read.parquet(f"{out}/dead").select(
        F.lit(None).cast("string").alias("job_id"),
        F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("int").alias("attempt"),
        F.col("value").cast("string").alias("body"),
    )
    return good.unionByName(dead)


def _repeated(spark, sf) -> DataFrame:
    """Messages as an at-least-once queue delivers them: up to three copies of each."""
    copies = F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))
    return _event_stream(spark, sf).select(
        F.expr(_JOB_ID).alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.explode(copies).alias("delivery")
    )


@query("stream_idempotent", f"SELECT {_JOB_ID} AS job_id FROM events")
def stream_idempotent(spark, sf):
    out = work_path(spark, "settled")
    S.settle_messages(_repeated(spark, sf), f"{out}/jobs", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/jobs").select("job_id")


@query("stream_dedupe_window", f"SELECT {_JOB_ID} AS job_id FROM events")
def stream_dedupe_window(spark, sf):
    out = work_path(spark, "deduped")
    (
        S.dedupe_messages(_repeated(spark, sf), "ts", "1 hour")
        .select("job_id")
        .writeStream.format("parquet")
        .option("path", f"{out}/jobs")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{out}/jobs")


@query(
    "stream_job_state",
    "SELECT user_id AS job_id, arg_max(event_type, ts) AS status, max(ts) AS ts FROM events GROUP BY 1",
)
def stream_job_state(spark, sf):
    out = work_path(spark, "state")
    events = _event_stream(spark, sf).select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts")
    S.write_job_state(events, f"{out}/changes", f"{out}/checkpoint").awaitTermination()
    return S.read_job_state(spark.read.parquet(f"{out}/changes"))


def _land(df: DataFrame, landing: str, by: str, fmt: str = "csv", **options) -> None:
    """Write one upload folder per value, each holding one file unless ``options`` say otherwise."""
    own = [name for name in df.columns if name != by]
    (
        df.repartition(by)
        .sortWithinPartitions(by, *own[:1])
        .write.mode("append")
        .options(**{"header": "true", **options})
        .partitionBy(by)
        .format(fmt)
        .save(landing)
    )


@query(
    "stream_ingest",
    """SELECT 'first=' || c_mktsegment AS session_id, 'ready' AS status, CAST(NULL AS VARCHAR) AS reject_reason,
         1 AS total_files, count(*) AS row_count FROM customer GROUP BY c_mktsegment
       UNION ALL SELECT 'again=' || c_mktsegment, 'failed', 'already_ingested', 1, NULL FROM customer GROUP BY c_mktsegment
       UNION ALL SELECT 'parquet=' || s_nationkey, 'ready', NULL, 1, count(*) FROM supplier GROUP BY s_nationkey
       UNION ALL SELECT 'json=' || n_nationkey, 'ready', NULL, 1, 1 FROM nation
       UNION ALL SELECT DISTINCT 'lines=' || n_regionkey, 'failed', 'unreadable', 1, NULL FROM nation
       UNION ALL SELECT 'utf16=' || r_regionkey, 'failed', 'unreadable', 1, NULL FROM region
       UNION ALL SELECT 'ragged=' || r_regionkey, 'failed', 'unreadable', 1, NULL FROM region
       UNION ALL SELECT 'many=1', 'failed', 'too_many_files', count(*), NULL FROM nation""",
)
def stream_ingest(spark, sf):
    root = work_path(spark, "landing")
    landing, out, checkpoint = f"{root}/in", f"{root}/out", f"{root}/checkpoint"
    customers, nations, regions = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    _land(customers.withColumnRenamed("c_mktsegment", "first"), landing, "first")
    _land(table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "parquet"), landing, "parquet", "parquet")
    _land(nations.withColumnRenamed("n_nationkey", "json"), landing, "json", "json")
    # Several objects one after another are no JSON document.
    _land(nations.withColumnRenamed("n_regionkey", "lines"), landing, "lines", "json")
    _land(regions.withColumnRenamed("r_regionkey", "utf16"), landing, "utf16", encoding="UTF-16")
    ragged = regions.select(F.col("r_regionkey").alias("ragged"), F.concat("r_name", F.lit(",more")).alias("r_name"))
    _land(ragged, landing, "ragged", quote="\0")
    _land(nations.withColumn("many", F.lit(1)), landing, "many", maxRecordsPerFile="1")
    N.ingest_stream(spark, landing, out, checkpoint).awaitTermination()
    # The same bytes land again under other names, and are refused.
    _land(customers.withColumnRenamed("c_mktsegment", "again"), landing, "again")
    N.ingest_stream(spark, landing, out, checkpoint).awaitTermination()
    tables = read_catalog(spark, out, "tables").groupBy("session_id").agg(F.sum("row_count").alias("row_count"))
    sessions = read_catalog(spark, out, "sessions", N.SESSIONS_SCHEMA)
    return sessions.join(tables, "session_id", "left").select(
        "session_id", "status", "reject_reason", "total_files", "row_count"
    )
