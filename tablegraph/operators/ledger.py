"""Rules over the job ledger: who may work on what, which results count, what happens next.

Jobs: ``job_id, session_id, status, attempt_count, error_message, queued_at,
started_at, completed_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEASE_SECONDS = 600
RECHECK_SECONDS = 30
RETRY_SECONDS = [5, 25]
MAX_ATTEMPTS = 3
STUCK_AFTER = "5 minutes"
SETTLED = ["done", "failed"]


def _before(c: Column, now: Column, seconds: int) -> Column:
    return c < now - F.expr(f"interval {int(seconds)} seconds")


def lease_expired(status: Column, started_at: Column, now: Column, lease: int = LEASE_SECONDS) -> Column:
    """Whether a job in progress has been held for longer than its lease."""
    return (status == "processing") & F.coalesce(_before(started_at, now, lease), F.lit(False))


def delivery_verdict(msgs: DataFrame, jobs: DataFrame, now: Column, lease: int = LEASE_SECONDS) -> DataFrame:
    """What a delivered message may do: its job is claimable, in progress, settled or missing."""
    state = jobs.select("job_id", "status", "started_at").withColumn("_known", F.lit(True))
    status = F.col("status")
    verdict = (
        F.when(F.col("_known").isNull(), "missing")
        .when(status.isin(SETTLED), "already_settled")
        .when((status == "queued") | lease_expired(status, F.col("started_at"), now, lease), "claimable")
        .otherwise("in_progress")
    )
    return msgs.join(state, "job_id", "left").select(*msgs.columns, verdict.alias("verdict"))


def expired_leases(jobs: DataFrame, now: Column, lease: int = LEASE_SECONDS) -> DataFrame:
    return jobs.where(lease_expired(F.col("status"), F.col("started_at"), now, lease))


def accepted_results(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results whose claim is still held: the job is in progress since that very claim."""
    held = jobs.where(F.col("status") == "processing").select("job_id", "started_at")
    return results.join(held, ["job_id", "started_at"], "left_semi")


def superseded_results(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """The complement of ``accepted_results``."""
    held = jobs.where(F.col("status") == "processing").select("job_id", "started_at")
    return results.join(held, ["job_id", "started_at"], "left_anti")


def retry_delay(attempt: Column) -> Column:
    """Seconds until the next try, given the attempt that failed; later ones wait the longest."""
    step = F.least(F.greatest(attempt, F.lit(1)), F.lit(len(RETRY_SECONDS)))
    return F.element_at(F.array(*map(F.lit, RETRY_SECONDS)), step.cast("int"))


def route_failures(failures: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Where each message goes next, after how many seconds, and with which attempt count.

    ``attempt`` counts deliveries already made; ``outcome`` is permanent,
    transient or held.
    """
    tried = F.col("attempt") + 1
    outcome = F.col("outcome")
    route = (
        F.when(outcome == "held", "retry")
        .when((outcome == "permanent") | (tried >= max_attempts), "dead")
        .otherwise("retry")
    )
    return failures.withColumn("route", route).withColumns(
        {
            "delay_seconds": F.when(outcome == "held", RECHECK_SECONDS).when(
                F.col("route") == "retry", retry_delay(tried)
            ),
            "next_attempt": F.when(
                (outcome != "held") & (F.col("route") == "retry"), tried
            ).otherwise(F.col("attempt")),
        }
    )


def apply_results(jobs: DataFrame, results: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs after the accepted results, with the state their session takes (null: unchanged).

    ``results`` has ``job_id, started_at, succeeded, permanent, message``. Results
    may arrive more than once, and contradict each other: one counts per job, a
    success before a failure and a permanent failure before a passing one.
    """
    one = F.max(F.struct("succeeded", "permanent", "message")).alias("_one")
    told = (
        accepted_results(results, jobs)
        .groupBy("job_id")
        .agg(one)
        .select("job_id", "_one.succeeded", "_one.permanent", F.col("_one.message").alias("_message"), F.lit(True).alias("_told"))
    )
    final = F.col("permanent") | (F.col("attempt_count") >= max_attempts)
    after = (
        F.when(F.col("_told").isNull(), F.col("status"))
        .when(F.col("succeeded"), "done")
        .when(final, "failed")
        .otherwise("queued")
    )
    settled = F.col("_told").isNotNull() & (F.col("succeeded") | final)
    return jobs.join(told, "job_id", "left").select(
        "job_id",
        "session_id",
        after.alias("status"),
        "attempt_count",
        F.when(F.col("_told").isNull(), F.col("error_message"))
        .when(~F.col("succeeded"), F.col("_message"))
        .alias("error_message"),
        "queued_at",
        "started_at",
        F.when(settled, now).otherwise(F.col("completed_at")).alias("completed_at"),
        F.when(F.col("_told").isNull(), None)
        .when(F.col("succeeded"), "ready")
        .when(final, "failed")
        .alias("session_status"),
    )


def stuck_jobs(jobs: DataFrame, now: Column, after: str = STUCK_AFTER) -> DataFrame:
    """Jobs that have been waiting in the queue for too long."""
    return jobs.where((F.col("status") == "queued") & (F.col("queued_at") < now - F.expr(f"interval {after}")))


def queue_depth(jobs: DataFrame) -> DataFrame:
    """Jobs per status."""
    return jobs.groupBy("status").agg(F.count("*").alias("n_jobs"))


def latest_job(jobs: DataFrame) -> DataFrame:
    """The newest job of each session, found while combining, without sorting a session's jobs."""
    newest = jobs.groupBy("session_id").agg(
        F.max_by(F.struct(*[c for c in jobs.columns if c != "session_id"]), F.struct("queued_at", "job_id")).alias("job")
    )
    return newest.select("session_id", "job.*")


def session_status(sessions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every session with the status and error of its newest job, null without one."""
    newest = latest_job(jobs).select(
        "session_id", F.col("status").alias("job_status"), "error_message"
    )
    return sessions.join(newest, "session_id", "left")
