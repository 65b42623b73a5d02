"""Job messages from an at-least-once queue: decoding, idempotence, current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

# Fixed value: the forms in which an identifier may be written.
UUID_PATTERN = (
    r"(?i)^(?:urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"
)
MESSAGE_SCHEMA = "job_id string, session_id string, attempt string"

# Where the state of a query lies when it may outgrow memory.
DISK_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

#: The attempt of a message that does not carry one.
FIRST_ATTEMPT = 0


def _uuid(c: Column) -> Column:
    digits = F.lower(F.regexp_replace(F.regexp_replace(c, r"(?i)^urn:uuid:", ""), r"[{}-]", ""))
    dashed = F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(c.rlike(UUID_PATTERN), dashed)


def decode_messages(stream: DataFrame, value: str = "value") -> DataFrame:
    """Read message bodies; a body that cannot be read keeps its bytes and is marked.

    Adds ``job_id``, ``session_id``, ``attempt`` and ``malformed``; works on
    batches and streams.
    """
    text = F.when(F.is_valid_utf8(F.col(value)), F.col(value).cast("string"))
    parsed = F.try_parse_json(text)
    # Read through the variant, so a key that is absent differs from a null.
    attempt = F.try_variant_get(parsed, "$.attempt", "string")
    absent = parsed.isNotNull() & ~F.array_contains(F.json_object_keys(text), "attempt")
    number = F.when(absent, F.lit(FIRST_ATTEMPT)).otherwise(
        F.when(attempt == "true", 1).when(attempt == "false", 0).otherwise(
            F.regexp_replace(F.trim(attempt), r"\.0+$", "").try_cast("int")
        )
    )
    decoded = stream.withColumns(
        {
            "job_id": _uuid(F.try_variant_get(parsed, "$.job_id", "string")),
            "session_id": _uuid(F.try_variant_get(parsed, "$.session_id", "string")),
            "attempt": number,
        }
    )
    broken = F.col("job_id").isNull() | F.col("session_id").isNull() | F.col("attempt").isNull()
    return decoded.withColumn("malformed", broken)


def route_messages(stream: DataFrame, jobs_path: str, dead_path: str, checkpoint: str) -> StreamingQuery:
    """Readable messages to one table, malformed bodies unchanged to another.

    Every micro-batch owns a partition of both tables, so a batch that runs
    twice after a failure replaces its own output.
    """
    columns = [name for name in stream.columns if name != "value"]

    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = decode_messages(batch).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        decoded.persist()
        try:
            good = decoded.where(~F.col("malformed")).drop("malformed", "value")
            bad = decoded.where(F.col("malformed")).select(*columns, "value", "batch_id")
            _replace_batch(good, jobs_path)
            _replace_batch(bad, dead_path)
        finally:
            decoded.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _replace_batch(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def dedupe_messages(stream: DataFrame, event_time: str, within: str) -> DataFrame:
    """One message per job id among those that arrive within the given delay of each other.

    State holds only the ids of that period. For exactness over all time use
    ``settle_messages``, which keeps every id as state.
    """
    return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["job_id"])


def settle_messages(stream: DataFrame, settled_path: str, checkpoint: str) -> StreamingQuery:
    """Write each job id once, however often and however late its messages arrive.

    The ids settled so far are keyed state in RocksDB, dealt by id and kept in the checkpoint: a micro-batch looks
    up its own ids only, whatever the number settled before, and the settled table is written, never read. A batch that
    runs twice starts from the state before it and replaces its own rows. The state lives and dies with the
    checkpoint; messages without an id count as one job.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _replace_batch(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), settled_path)

    return _start_on_disk_state(
        stream.sparkSession,
        stream.dropDuplicates(["job_id"])
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True),
    )


def _start_on_disk_state(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start a query whose state is kept by RocksDB, with its changes alone written each batch."""
    before = {name: spark.conf.get(name, None) for name in DISK_STATE}
    try:
        for name, value in DISK_STATE.items():
            spark.conf.set(name, value)
        return writer.start()  # takes the settings along
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def job_state_stream(events: DataFrame) -> DataFrame:
    """The latest state of each job, as an update-mode aggregation over its events.

    Of events at one time the status last by name counts, whatever order they arrive in.
    """
    return events.groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "status")).alias("status"),
        F.max("ts").alias("ts"),
    )


def write_job_state(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the changed states of every micro-batch; ``read_job_state`` gives the current ones."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _replace_batch(batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")), path)

    return _start_on_disk_state(
        events.sparkSession,
        job_state_stream(events)
        .writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True),
    )


def read_job_state(changes: DataFrame) -> DataFrame:
    """The current state per job from the changes written so far."""
    return changes.groupBy("job_id").agg(
        F.max_by("status", "batch_id").alias("status"), F.max_by("ts", "batch_id").alias("ts")
    )
