"""Exact similarity join on word shingles: size-banded tiles, bitmap bounds, sorted-array intersection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.llm.common import (
    WordHashes,
    arrow_map,
    batch,
    components,
    join_checked,
    lists,
    pieces,
    saved,
    shingles,
    sorted_runs,
    text_bytes,
    texts,
    word_bytes,
)

#: Two sets link when ``PARTS * intersection >= SHARE * union``.
SHARE, PARTS = 80, 100
#: Members of one block of a tile; a tile is one block or two neighbouring ones.
BLOCK = 4096
#: Rows, in order of size, among which the nearest partner of each is sought.
NEAR = 512
#: Bitmap words compared at once.
AT_ONCE = 4 << 20
#: Tasks forget the sets they have already sent after this many.
REMEMBERED_SETS = 200_000

_SETS = "doc_id long, n_shingles long, key long, key2 long, prefix array<long>, bitmap binary"


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingles of a whole text."""
    return np.unique(shingles(hashes.of(word_bytes(text))))


def prefix_length(n: int) -> int:
    """Smallest shingles of a set of ``n`` of which any linked set must hold one: a linked set shares at
    least ``SHARE / PARTS`` of them, so it can't miss one more than the rest."""
    return n - -(-SHARE * n // PARTS) + 1


def bitmap(values: np.ndarray) -> np.ndarray:
    """Parities of the shingles per bit; as many bits as shingles or a little more, a power of two."""
    bits = 64 << max(0, int(len(values) - 1).bit_length() - 6)
    parity = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def sets_of(docs: DataFrame) -> DataFrame:
    """Per document its set's size, a 128-bit key equal for equal sets, prefix and bitmap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sent = WordHashes(), set()
        nothing = np.zeros(0, np.uint64)
        for part in pieces(batches):
            sizes, keys, prefixes, maps = [], [], [], []
            for text, named in zip(text_bytes(part), part.column("doc_id").is_valid().to_pylist(), strict=True):
                values = shingle_set(text, hashes)
                n = len(values)
                key = np.frombuffer(hashlib.md5(values.tobytes()).digest(), np.int64)
                fresh = n and named and key[0] not in sent
                if fresh:  # copies met by the same task send their set once; a row without an id takes no part
                    if len(sent) >= REMEMBERED_SETS:
                        sent.clear()
                    sent.add(key[0])
                sizes.append(n)
                keys.append(key)
                prefixes.append(values[: prefix_length(n)] if fresh else nothing)
                maps.append(bitmap(values).tobytes() if n else None)
            stacked = np.array(keys, np.int64).reshape(-1, 2)
            yield batch(
                doc_id=part.column("doc_id"),
                n_shingles=pa.array(sizes, pa.int64()),
                key=np.ascontiguousarray(stacked[:, 0]),
                key2=np.ascontiguousarray(stacked[:, 1]),
                prefix=lists(prefixes),
                bitmap=pa.array(maps, pa.binary()),
            )

    return arrow_map(texts(docs), work, _SETS)


def tiles(sets: DataFrame) -> DataFrame:
    """Rows (tile, key): sets of similar size that share a prefix shingle.

    Prefix rows are sorted by shingle and size inside their partitions and read as a stream of runs; a run
    of one set ends there. A run is cut into blocks by size, and each block forms a tile with itself and with
    each earlier block whose sizes are still within reach, so no tile holds more than two blocks. Copies of
    one document share nearly all their runs: equal tiles are one.
    """
    rows = sets.select(F.explode("prefix").alias("shingle"), F.col("n_shingles").alias("n"), "key")
    ordered = rows.repartition("shingle").sortWithinPartitions("shingle", "n", "key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts in sorted_runs(batches, "shingle"):
            ids, members, seen = [], [], set()
            for at in np.flatnonzero(np.diff(starts) > 1):
                keys, n = columns["key"][starts[at] : starts[at + 1]], columns["n"][starts[at] : starts[at + 1]]
                fresh = np.r_[True, keys[1:] != keys[:-1]]
                keys, n = keys[fresh], n[fresh]
                for lo in range(0, len(keys), BLOCK):
                    block = keys[lo : lo + BLOCK]
                    # Sizes rise: earlier blocks are in reach from the first row with 100 n >= 80 of this block's least.
                    reach = int(np.searchsorted(n * PARTS, n[lo] * SHARE))
                    for other in range(reach // BLOCK * BLOCK, lo + 1, BLOCK):
                        pair = block if other == lo else np.r_[keys[other : other + BLOCK], block]
                        if len(pair) < 2:
                            continue
                        tile = int.from_bytes(hashlib.blake2b(pair.tobytes(), digest_size=8).digest(), "little", signed=True)
                        if tile not in seen:
                            seen.add(tile)
                            ids.append(np.full(len(pair), tile, np.int64))
                            members.append(pair)
                    if sum(map(len, ids)) > 200_000:
                        yield batch(tile=np.concatenate(ids), key=np.concatenate(members))
                        ids, members = [], []
            if ids:
                yield batch(tile=np.concatenate(ids), key=np.concatenate(members))

    return arrow_map(ordered, work, "tile long, key long").distinct()


def _within(n: np.ndarray, maps: list[np.ndarray], group: np.ndarray, nearest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a tile's rows, sorted by size, from different groups whose bitmaps allow a link.

    Parities differ in at most as many bits as the sets differ in elements, so
    ``(n1 + n2 - differing bits) / 2`` bounds the intersection from above. With ``nearest`` each row has
    at most its best pair. Returns row, row and the bound's slack.
    """
    first, second, slack = [], [], []
    sizes = np.array([len(m) for m in maps])
    for width in np.unique(sizes):
        # Rows of this width against rows as wide or wider, those folded to it.
        own = np.flatnonzero(sizes == width)
        reach = np.flatnonzero((sizes >= width) & (n * SHARE <= n[own].max() * PARTS))
        table = np.stack([folded(maps[k], width) for k in reach])
        step = max(1, AT_ONCE // (len(reach) * int(width)))
        for lo in range(0, len(own), step):
            rows = own[lo : lo + step]
            mine = np.stack([maps[k] for k in rows])
            differ = np.bitwise_count(mine[:, None, :] ^ table[None, :, :]).sum(axis=2, dtype=np.int64)
            total = n[rows][:, None] + n[reach][None, :]
            # 100 * o >= 80 * (total - o), with 2 * o at most total - differ.
            room = (PARTS + SHARE) * (total - differ) - 2 * SHARE * total
            order = (sizes[reach][None, :] > width) | (reach[None, :] > rows[:, None])
            other = group[rows][:, None] != group[reach][None, :]
            sized = (n[rows][:, None] * PARTS >= n[reach][None, :] * SHARE) & (n[reach][None, :] * PARTS >= n[rows][:, None] * SHARE)
            good = (room >= 0) & order & other & sized
            a, b = np.nonzero(good)
            first.append(rows[a])
            second.append(reach[b])
            slack.append((differ[a, b] * 1000 // np.maximum(1, total[a, b])))
    a, b, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second, slack))
    if nearest and len(a):
        # The closest partner of each row, and the first row of all with those it may link to.
        ends = np.r_[a, b]
        pairs = np.r_[np.arange(len(a)), np.arange(len(a))]
        order = np.lexsort((pairs, np.r_[s, s], ends))
        closest = pairs[order][np.r_[True, ends[order][1:] != ends[order][:-1]]]
        chosen = np.unique(np.r_[closest, np.flatnonzero(np.minimum(a, b) == 0)])
        a, b, s = a[chosen], b[chosen], s[chosen]
    return a, b, s


def candidates(placed: DataFrame, nearest: bool) -> DataFrame:
    """Distinct pairs (key_a, key_b) of different groups that share a tile and whose bitmaps allow a link.

    ``placed``: tile, key, n, bitmap, group, and ``tiles``, some tiles of the key in rising order. A pair that finds
    a common one in these two lists is given by the first such tile alone; any other pair by each tile it shares.
    """
    ordered = placed.repartition("tile").sortWithinPartitions("tile", "n", "key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts in sorted_runs(batches, "tile"):
            for at in range(len(starts) - 1):
                for lo in range(starts[at], starts[at + 1], NEAR if nearest else 2 * BLOCK):
                    own = slice(lo, min(starts[at + 1], lo + NEAR) if nearest else starts[at + 1])
                    group = columns["group"][own]
                    if (group == group[0]).all():
                        continue
                    maps = [np.frombuffer(m.as_buffer(), np.uint64) for m in columns["bitmap"][own.start : own.stop]]
                    keys = columns["key"][own]
                    a, b, s = _within(columns["n"][own], maps, group, nearest)
                    if len(a) and not nearest:
                        lists_of = columns["tiles"][own.start : own.stop].to_pylist()
                        tile, known = int(columns["tile"][lo]), [set(t) for t in lists_of]
                        here = [not (c := known[x] & known[y]) or min(c) == tile for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                        a, b, s = a[here], b[here], s[here]
                    if len(a):
                        low, high = np.minimum(keys[a], keys[b]), np.maximum(keys[a], keys[b])
                        yield batch(key_a=low, key_b=high, slack=s)

    found = arrow_map(ordered, work, "key_a long, key_b long, slack long").groupBy("key_a", "key_b").agg(F.min("slack").alias("slack"))
    if not nearest:
        return found.select("key_a", "key_b")
    # Two partners of each set are enough to begin with: the closest and the smallest.
    ends = found.select(F.explode(F.array("key_a", "key_b")).alias("key"), "key_a", "key_b", "slack")
    best = ends.groupBy("key").agg(
        F.min(F.struct("slack", "key_a", "key_b")).alias("best"), F.min(F.struct("key_a", "key_b")).alias("least")
    )
    both = best.select(F.explode(F.array(F.struct("best.key_a", "best.key_b"), "least")).alias("pair"))
    return both.select("pair.key_a", "pair.key_b").distinct()


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets truly link, as (a, b) in ids of class representatives.

    The texts of the representatives concerned are read again and their sets joined to the pairs, so only
    sets with a candidate ever move.
    """
    pairs = saved(pairs, "pairs")
    needed = pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    wanted = saved(classes.join(needed, "key").select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    again = join_checked(texts(docs), wanted, ["doc_id"], "left_semi", 24)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in pieces(batches):
            values = [shingle_set(text, hashes) for text in text_bytes(part)]
            yield batch(
                doc_id=part.column("doc_id"),
                key=pa.array([int(np.frombuffer(hashlib.md5(v.tobytes()).digest(), np.int64)[0]) for v in values], pa.int64()),
                shingles=pa.array([v.tobytes() for v in values], pa.binary()),
            )

    sets = saved(arrow_map(again, read, "doc_id long, key long, shingles binary"), "sets")
    sides = [sets.select(F.col("key").alias(f"key_{s}"), F.col("doc_id").alias(s), F.col("shingles").alias(f"set_{s}")) for s in "ab"]
    both = pairs.join(sides[0], "key_a").join(sides[1], "key_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            good = []
            for a, b in zip(part.column("set_a"), part.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(PARTS * shared >= SHARE * (len(x) + len(y) - shared))
            kept = part.filter(pa.array(good, pa.bool_()))
            yield batch(a=kept.column("a"), b=kept.column("b"))

    return arrow_map(both, check, "a long, b long")


def link(docs: DataFrame) -> DataFrame:
    """Per document the size of its shingle set and the smallest id reachable by links.

    Equal sets are one class, named by its smallest id; only one set per class is joined. Any two sets that
    link share a shingle of their prefixes (the smallest 20 % and one more by hash), so they meet in a tile;
    bitmaps then bound their intersection, and the pairs left are verified on the whole sorted sets. First
    each set's nearest partners are verified; groups found so are joined, and then all pairs of different
    groups that the bitmaps allow. Copies are thus joined through few pairs, and no link between groups is
    lost.

    Null and empty texts have an empty set and stay alone; fewer than five words are one shingle. Rows
    without an id take part in no link and have a null component. Rows that repeat an id with another text
    are linked under that id.
    """
    spark = docs.sparkSession
    sets = saved(sets_of(docs), "shingle_sets")
    counted = sets.where("n_shingles > 0 and doc_id is not null")
    classes = saved(
        counted.groupBy("key", "key2").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bitmap").alias("bitmap")
        ),
        "classes",
    )
    placed = saved(tiles(counted), "tiles")
    info = classes.groupBy("key").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.min("rep").alias("rep"))
    info = saved(info.join(placed.select("key").distinct(), "key", "left_semi"), "members")
    rows = placed.join(info, "key").select("tile", "key", "n", F.col("rep").alias("group"))

    def mapped(rows: DataFrame) -> DataFrame:
        """The rows with their bitmaps, which are joined last: they move once, and only for tiles that are read."""
        return rows.join(info.select("key", "bitmap"), "key")

    def sampled(rows: DataFrame, round_: int) -> DataFrame:
        """Two tiles per set, the same ones for sets that share most of theirs: nearest partners are sought there."""
        hashed = rows.withColumn("hash", F.xxhash64("tile", F.lit(round_)))
        own = hashed.groupBy("key").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        chosen = hashed.join(own, "key").where("hash = lo or hash = hi")
        return chosen.select("tile", "key", "n", "group", F.array().cast("array<long>").alias("tiles"))

    edges = saved(verified(docs, classes, candidates(mapped(sampled(rows, 0)), nearest=True)), "near")
    for nearest in (True, False):
        found = components(edges, spark).withColumnRenamed("id", "group").withColumnRenamed("component", "joined")
        grouped = (
            rows.join(found, "group", "left")
            .select("tile", "key", "n", F.coalesce("joined", "group").alias("group"))
        )
        # Tiles of one group have no pair left.
        open_tiles = grouped.groupBy("tile").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi")
        grouped = grouped.join(open_tiles.select("tile"), "tile", "left_semi")
        if nearest:
            grouped = sampled(grouped, 1)
        else:
            some = F.slice(F.array_sort(F.collect_set("tile")), 1, 8).alias("tiles")
            grouped = grouped.join(grouped.groupBy("key").agg(some), "key")
        edges = saved(edges.unionByName(verified(docs, classes, candidates(mapped(grouped), nearest))), "near")
    # Rows of one id with several texts link the classes of those texts.
    own = sets.select("doc_id", "n_shingles", "key", "key2").join(classes.select("key", "key2", "rep"), ["key", "key2"], "left")
    several = own.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b")
    several = own.join(several.select("doc_id", "a"), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    final = saved(components(edges.unionByName(several), spark), "components")
    named = own.join(final.withColumnRenamed("id", "rep"), "rep", "left")
    return named.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
    )


def representatives(docs: DataFrame) -> DataFrame:
    """The ids of the documents to keep: the smallest of each group."""
    return link(docs).where("component_id = doc_id").select("doc_id")
