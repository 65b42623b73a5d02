"""Row positions: a dense 0-based ``_row_id`` in stored order, without a global sort.

A scan hands out rows file by file and block by block, so a row's position is
the number of rows in earlier pieces plus its place inside its own piece. Only
the per-piece counts (one row per file or file block) are ever put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegraph.session import work_root

ROW_ID = "_row_id"

#: Offsets of up to this many files or file blocks are sent to every task;
#: more are joined.
MOST_PIECES = 1_000_000

#: Bits that ``monotonically_increasing_id`` leaves for the place in a partition.
_PLACE_BITS = 33


def _offsets(counts: DataFrame, order: list[str]) -> DataFrame:
    """Rows in earlier pieces, per piece. One input row per piece, so one task is enough."""
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))


def _sized(offsets: DataFrame, pieces: int | None) -> DataFrame:
    """Offsets ready to join: broadcast when their number is known to be small."""
    return F.broadcast(offsets) if pieces is not None and pieces <= MOST_PIECES else offsets


def parquet_with_row_id(spark: SparkSession, path: str, row_id: str = ROW_ID) -> DataFrame:
    """A Parquet table with each row's position, files taken in path order.

    The reader knows a row's index inside its file; a table of one file needs
    nothing more, and a table of many adds the row counts of the files before.
    No table row is shuffled.
    """
    table = spark.read.parquet(path)
    if row_id in table.columns:
        return table
    index = F.col("_metadata.row_index")
    files = len(table.inputFiles())
    if files <= 1:
        return table.withColumn(row_id, index)

    file = F.col("_metadata.file_path")
    counts = table.groupBy(file.alias("_piece")).agg((F.max(index) + 1).alias("_rows"))
    offsets = _offsets(counts, ["_piece"]).select("_piece", "_before")
    placed = table.withColumn("_piece", file).withColumn("_index", index)
    return (
        placed.join(_sized(offsets, files), "_piece")
        .withColumn(row_id, F.col("_before") + F.col("_index"))
        .select(*table.columns, row_id)
    )


def scan_order(df: DataFrame) -> DataFrame:
    """Mark rows of a text or CSV scan with their file, block and running number.

    Must be applied straight after the scan: ``_place`` follows the order in
    which one task reads a block, and later steps keep it as plain data.
    """
    return df.select(
        *df.columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).withColumn("_place", F.monotonically_increasing_id())


def number_small_file(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Positions in a file that one task reads, where the running number is the position."""
    return df.select(*df.columns, F.monotonically_increasing_id().alias(row_id))


def scan_offsets(scanned: DataFrame, per: list[str] | None = None) -> DataFrame:
    """One row per file block: its first running number and the rows in earlier blocks."""
    per = per or []
    piece = ["_file", "_block"]
    counts = scanned.groupBy(*per, *piece).agg(
        F.min("_place").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = (
        Window.partitionBy(*per).orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    return counts.withColumn("_before", before).drop("_rows")


def number_scan(
    scanned: DataFrame,
    row_id: str = ROW_ID,
    per: list[str] | None = None,
    offsets: DataFrame | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Turn the marks of ``scan_order`` into dense positions.

    ``per`` restarts the count for each of its values (such as a table name).
    Offsets that were stored before spare counting the blocks again; ``pieces``
    is the most file blocks there can be, if known.
    """
    per = per or []
    if offsets is None:
        offsets = scan_offsets(scanned, per)
    keep = [name for name in scanned.columns if name not in ("_file", "_block", "_place")]
    return (
        scanned.join(_sized(offsets, pieces), [*per, "_file", "_block"])
        .withColumn(row_id, F.col("_before") + F.col("_place") - F.col("_first"))
        .select(*keep, row_id)
    )


def with_row_id(df: DataFrame, *order_by: str | Column, row_id: str = ROW_ID) -> DataFrame:
    """Number the rows of any DataFrame in the given order.

    One range shuffle puts rows in order across partitions; the result is
    checkpointed, so partition boundaries cannot move between counting the
    partitions and numbering their rows, even when an executor is lost. Rows
    that tie keep the order they are read in, which also lets a run of equal
    keys spread over many partitions.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_root(spark))
    read = df.withColumn("_read", F.monotonically_increasing_id())
    ordered = read.orderBy(*order_by, "_read").drop("_read")
    stored = ordered.withColumn("_place", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_place", _PLACE_BITS)
    counts = stored.groupBy(part.alias("_piece")).agg(F.count("*").alias("_rows"))
    offsets = _sized(_offsets(counts, ["_piece"]).select("_piece", "_before"), stored.rdd.getNumPartitions())
    place = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        stored.withColumn("_piece", part)
        .join(offsets, "_piece")
        .withColumn(row_id, F.col("_before") + place)
        .select(*df.columns, row_id)
    )
