"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Runtime settings the operators rely on.
SETTINGS = {
    # Catalog times are UTC; text forms of timestamps must not depend on the host.
    "spark.sql.session.timeZone": "UTC",
    # Column names come from files, where ``Id`` and ``id`` are two columns.
    "spark.sql.caseSensitive": "true",
    # A repeated key inside one JSON object: the last value wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Hot join keys are split at run time; sizes are measured before a broadcast.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

#: Settings that only take effect when a session is built.
BUILD_SETTINGS = {
    # Recording where each column expression was written costs more than
    # planning it, which shows on tables with many columns.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and return it."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def work_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting falls back to a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="tablegraph-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the work folder, unique to this call."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
