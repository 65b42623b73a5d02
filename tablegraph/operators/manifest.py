"""Intake rules over a manifest: one row per file of a batch, no file rejected unseen.

Columns: ``batch``, ``pos`` (place in the batch), ``filename`` as sent,
``size`` in bytes, ``sha256``.

The rule on the number of files comes first, as it does at intake, and every
rule that compares files of a batch looks only at batches that pass it. So the
windows below hold at most ``max_files`` rows each, however large a rejected
batch may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegraph.functions.filenames import format_of, safe_filename

MAX_FILES = 5
MAX_BATCH_BYTES = 20 * 1024 * 1024

# Reasons in the order the rules are checked. Within one stage
# the files are taken in order, and the first file to break a rule decides.
REASONS = [
    (0, "no_files"),
    (0, "too_many_files"),
    (1, "invalid_filename"),
    (1, "duplicate_filename"),
    (1, "invalid_extension"),
    (2, "mixed_formats"),
    (3, "empty_file"),
    (3, "batch_too_large"),
    (3, "duplicate_content"),
    (4, "already_ingested"),
]


def hashed(files: DataFrame, max_bytes: int = MAX_BATCH_BYTES) -> DataFrame:
    """Binary files with size, sha256 and text validity, without their content.

    Files past ``max_bytes`` are listed without being read: their batch is
    refused for its size alone, so they have neither hash nor validity.
    """
    kept = [F.col(name) for name in files.columns if name not in ("length", "content")]
    small = files.where(F.col("length") <= max_bytes).select(
        *kept,
        F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"),
        F.is_valid_utf8(F.col("content")).alias("utf8"),
    )
    large = files.where(F.col("length") > max_bytes).select(
        *kept,
        F.col("length").alias("size"),
        F.lit(None).cast("string").alias("sha256"),
        F.lit(None).cast("boolean").alias("utf8"),
    )
    return small.unionByName(large)


def manifest(spark: SparkSession, path: str, max_bytes: int = MAX_BATCH_BYTES) -> DataFrame:
    """Path, size, sha256 and text validity of each file, hashed where it is read.

    ``max_bytes`` is the batch limit the files will be checked against.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return hashed(files, max_bytes).drop("modificationTime")


def describe_content(files: DataFrame, content: str = "content") -> DataFrame:
    """Add size, sha256 and validity of a content column, and drop the content."""
    c = F.col(content)
    return files.withColumns(
        {"size": F.octet_length(c), "sha256": F.sha2(c, 256), "utf8": F.is_valid_utf8(c)}
    ).drop(content)


def check_utf8(files: DataFrame, content: str = "content") -> DataFrame:
    """Files whose bytes are not valid UTF-8."""
    return files.where(~F.is_valid_utf8(F.col(content)))


def batch_file_count(m: DataFrame, batches: DataFrame | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """Files per batch and the reason a batch has too few or too many.

    ``batches`` lists batches that were opened, so one without files shows up.
    """
    counts = m.groupBy("batch").agg(F.count("*").alias("n_files"))
    if batches is not None:
        counts = (
            batches.select("batch")
            .distinct()
            .join(counts, "batch", "left")
            .select("batch", F.coalesce("n_files", F.lit(0)).cast("bigint").alias("n_files"))
        )
    reason = F.when(F.col("n_files") == 0, "no_files").when(F.col("n_files") > max_files, "too_many_files")
    return counts.withColumn("reject_reason", reason)


def bounded_batches(m: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Files of batches within the file limit; every window over a batch starts here."""
    fine = batch_file_count(m, max_files=max_files).where(F.col("reject_reason").isNull())
    return m.join(fine.select("batch"), "batch", "left_semi")


def check_batch(m: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BATCH_BYTES) -> DataFrame:
    """Each file with one flag per rule it breaks.

    Files of a batch over the file limit are marked ``too_many_files`` and their
    other flags are null: no other rule looks at them. Files without a hash
    equal no other file.
    """
    name = safe_filename(F.col("filename"))
    counts = batch_file_count(m, max_files=max_files)
    over = counts.select("batch", F.col("reject_reason").isNotNull().alias("too_many_files"))
    # A refused batch is spread by position, so that a window holds at most ``max_files`` of its rows.
    spread = F.when(F.col("too_many_files"), F.col("pos").cast("string"))
    checked = m.join(over, "batch").withColumns({"name": name, "_spread": spread}).withColumn("fmt", format_of(F.col("name")))
    batch = Window.partitionBy("batch", "_spread")
    same_name = Window.partitionBy("batch", "_spread", "name").orderBy("pos")
    same_bytes = Window.partitionBy("batch", "_spread", "sha256").orderBy("pos")
    so_far = batch.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # Windows over the batch come first: their one shuffle by batch then also
    # serves the finer ones.
    whole = checked.withColumns(
        {
            "running_size": F.sum("size").over(so_far),
            "mixed_formats": F.size(F.collect_set("fmt").over(batch)) > 1,
        }
    )
    flags = {
        "running_size": F.col("running_size"),
        "mixed_formats": F.col("mixed_formats"),
        "invalid_filename": F.col("name").isNull(),
        "duplicate_filename": F.col("name").isNotNull() & (F.row_number().over(same_name) > 1),
        "invalid_extension": F.col("name").isNotNull() & F.col("fmt").isNull(),
        "empty_file": F.col("size") == 0,
        "batch_too_large": F.col("running_size") > max_bytes,
        "duplicate_content": F.col("sha256").isNotNull() & (F.row_number().over(same_bytes) > 1),
    }
    looked_at = {flag: F.when(~F.col("too_many_files"), value) for flag, value in flags.items()}
    return whole.withColumns(looked_at).drop("_spread")


def duplicate_content(m: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Files whose bytes came earlier in their batch."""
    same_bytes = Window.partitionBy("batch", "sha256").orderBy("pos")
    return (
        bounded_batches(m, max_files)
        .withColumn("first_pos", F.first("pos").over(same_bytes))
        .where(F.col("sha256").isNotNull() & (F.col("first_pos") < F.col("pos")))
    )


def already_ingested(m: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose bytes are already on record, all hashes in one join.

    Recorded hashes are made distinct before they are shuffled, so a text that
    was stored many times is one row of the join.
    """
    return m.join(files.select("sha256").distinct(), "sha256", "left_semi")


def not_yet_ingested(m: DataFrame, files: DataFrame) -> DataFrame:
    """The complement of ``already_ingested``."""
    return m.join(files.select("sha256").distinct(), "sha256", "left_anti")


def reject_reason(
    m: DataFrame,
    known: DataFrame | None = None,
    batches: DataFrame | None = None,
    max_files: int = MAX_FILES,
    max_bytes: int = MAX_BATCH_BYTES,
) -> DataFrame:
    """One row per batch: the first rule it breaks and the file that broke it, null when accepted."""
    counts = batch_file_count(m, batches, max_files)
    files = check_batch(m, max_files, max_bytes)
    if known is None:
        files = files.withColumn("already_ingested", F.lit(False))
    else:
        seen = known.select("sha256").distinct().withColumn("_seen", F.lit(True))
        files = files.join(seen, "sha256", "left").withColumn("already_ingested", F.col("_seen").isNotNull())

    broken = [
        F.when(
            F.col(reason) & ~F.col("too_many_files"),
            # A rule about the whole batch is not tied to one of its files.
            F.struct(
                F.lit(stage).alias("stage"),
                F.when(F.lit(stage != 2), F.col("pos")).alias("pos"),
                F.lit(rank).alias("rank"),
                F.lit(reason).alias("reason"),
            ),
        )
        for rank, (stage, reason) in enumerate(REASONS)
        if stage > 0
    ]
    first = (
        files.select("batch", F.array_min(F.array_compact(F.array(*broken))).alias("first"))
        .groupBy("batch")
        .agg(F.min("first").alias("first"))
    )
    return counts.join(first, "batch", "left").select(
        "batch",
        "n_files",
        F.coalesce("reject_reason", "first.reason").alias("reject_reason"),
        F.col("first.pos").alias("at_pos"),
    )


def batch_totals(m: DataFrame) -> DataFrame:
    """File count and bytes per batch."""
    return m.groupBy("batch").agg(
        F.count("*").alias("total_files"), F.sum("size").cast("bigint").alias("total_size_bytes")
    )


# Fixed value: texts that read as a number, so a header made of them is data.
NUMBER_PATTERN = (
    r"^[+-]?(?i:nan|inf|infinity|(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)"
    r"(?:e[+-]?[0-9](?:_?[0-9])*)?)$"
)
UNNAMED_PREFIX = "Unnamed:"


def check_csv_headers(lines: DataFrame, names: Column) -> DataFrame:
    """Add the header's column names and the reason it cannot be a header, null when it can."""
    checked = lines.withColumn("names", F.transform(names, lambda name: F.trim(name)))
    header = F.col("names")
    reason = (
        F.when(F.size(header) <= 0, "no_header")
        .when(F.exists(header, lambda n: (n == "") | n.startswith(UNNAMED_PREFIX)), "unnamed_column")
        .when(F.size(F.array_distinct(header)) < F.size(header), "repeated_column")
        .when(F.forall(header, lambda n: n.rlike(NUMBER_PATTERN)), "starts_with_data")
    )
    return checked.withColumn("reject_reason", reason)
