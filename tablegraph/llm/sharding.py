"""Longest-processing-time scheduling of documents onto shards."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegraph.llm.common import saved

#: Groups of more than the total over this many bytes are scheduled one by one.
LARGE_SHARE = 8192
#: Bundles of the smaller groups: most of them in coarse ones, the rest in fine ones that level the loads.
BUNDLES = 2048
#: Share of the groups, in 64ths, that goes to fine bundles.
FINE = 6
#: Rows of one numbering cell.
CELL_ROWS = 50_000


def schedule(items: list[tuple[int, int]], n_shards: int) -> dict[int, int]:
    """(key, size) to shard: by falling size, each to the shard with the least load so far."""
    heap = [(0, shard) for shard in range(n_shards)]
    placed = {}
    for key, size in sorted(items, key=lambda item: (-item[1], item[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[key] = shard
    return placed


def shard(docs: DataFrame, n_shards: int = 24, overhead: int = 8) -> DataFrame:
    """A shard and a slot for every row; equal texts stay together and the shards' bytes are near equal.

    A group is all rows of one text (a null text goes with the empty one). Groups over 1/8192 of all bytes,
    of which there can be at most 8192, are scheduled one by one; the others are bundled by the hash of
    their text, and the bundles, at most 4096, are scheduled with them. So the heap sees a bounded number
    of items at any scale, while a small table is scheduled nearly group by group. Groups whose 64-bit
    hashes meet share a shard, which breaks no rule.

    Slots count from 0 in each shard without gaps, over cells of bounded size, by ``doc_id`` in a cell.
    Null ids come first; rows equal in every column get slots in some order; an empty table gives no row.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )
    groups = saved(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total, n_rows = groups.agg(F.sum("bytes"), F.sum("n")).first()
    # Group keys are 64 bits wide; bundle keys are the numbers below 2 * BUNDLES of a column of their own.
    is_large = F.col("bytes") * LARGE_SHARE > F.lit(total or 0)
    within = F.pmod(F.shiftrightunsigned(F.col("group"), 8), F.lit(BUNDLES))
    bundle = F.when(F.pmod(F.col("group"), F.lit(64)) < FINE, within + BUNDLES).otherwise(within)
    large = groups.where(is_large).select("group", "bytes").collect()
    bundles = groups.where(~is_large).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes")).collect()
    placed = schedule(
        [((0, row["group"]), row["bytes"]) for row in large] + [((1, row["bundle"]), row["bytes"]) for row in bundles],
        n_shards,
    )
    # Both tables are bounded by the constants above.
    by_group = spark.createDataFrame(
        [(key, where) for (kind, key), where in placed.items() if kind == 0], "group long, own int"
    )
    by_bundle = spark.createDataFrame(
        [(key, where) for (kind, key), where in placed.items() if kind == 1], "bundle long, shared int"
    )
    placed_rows = saved(
        rows.join(F.broadcast(by_group), "group", "left")
        .withColumn("bundle", bundle)
        .join(F.broadcast(by_bundle), "bundle", "left")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.coalesce("own", "shared").alias("shard"),
            F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, (n_rows or 0) // (n_shards * CELL_ROWS)))).alias("cell"),
        ),
        "placed",
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed_rows.groupBy("shard", "cell")
        .agg(F.count("*").alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32")) - 1
    return (
        placed_rows.withColumn("place", place)
        .join(starts, ["shard", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
