"""SimHash near-duplicates found by fuzzy hashing with the binary Golay code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegraph.llm.common import arrow_map, batch, components, join_checked, pieces, saved, sorted_runs, text_bytes, texts

#: Words of a shingle, and the seed of its hash.
WORDS, SEED = 3, 42
#: Fingerprints link when they differ in at most this many of 64 bits.
ERRORS = 2
#: First bit and number of bits of the segments; with ``ERRORS`` errors one of them has none and the next at most one.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the (23, 12) Golay code, a fixed value.
GENERATOR = 0b110001110101
#: A key of more fingerprints than this is crowded: its fingerprints meet at midpoints instead.
CROWD = 64
#: Fingerprints of more rows than this are joined to their rows apart from the rest.
COMMON = 1000
#: Hashes whose bits are counted at once.
AT_ONCE = 1 << 16


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Parity of each 12-bit index and, per 11-bit syndrome, the one error of at most three bits that causes it."""
    parity = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        parity = np.where(parity >> bit & 1, parity ^ (GENERATOR << (bit - 11)), parity)
    errors = np.zeros(2048, np.int64)
    bits = [1 << k for k in range(23)]
    for a in bits:
        for b in bits:
            for c in bits:
                error = a | b | c
                errors[parity[error >> 11] ^ (error & 2047)] = error
    return parity, errors


def decoded(words: np.ndarray) -> np.ndarray:
    """The index of the codeword nearest to each 23-bit word; every word lies within three bits of one."""
    parity, errors = golay()
    syndrome = parity[words >> 11] ^ (words & 2047)
    return (words ^ errors[syndrome]) >> 11


def nearby(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the codewords nearest to a word or to one with one of its ``bits`` lowest bits changed: one
    to six for each word. Two words that differ in one bit share an index, since each is near the other's."""
    around = words[:, None] ^ np.array([0] + [1 << k for k in range(bits)], np.int64)[None, :]
    index = np.sort(decoded(around), axis=1)
    fresh = np.ones(index.shape, bool)
    fresh[:, 1:] = index[:, 1:] != index[:, :-1]
    row, column = np.nonzero(fresh)
    return row, index[row, column]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): a segment as it is, with each nearby codeword of the next segment.

    Two errors leave one of three segments clean. If they lie in one segment, the clean one before the other clean
    one meets it; if in two, the third is clean and any other has one error, which the nearby codewords bear.
    """
    rows, keys = [], []
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    for k in range(len(SEGMENTS)):
        following = (k + 1) % len(SEGMENTS)
        row, index = nearby(parts[following], SEGMENTS[following][1])
        rows.append(row)
        keys.append(k << 34 | parts[k][row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes) -> int:
    """Bits set in over half of the hashes of a text's word shingles; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(WORDS, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, len(starts), AT_ONCE):
        spans = zip(starts[lo : lo + AT_ONCE], ends[lo : lo + AT_ONCE], strict=True)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in spans], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``print``, the fingerprint as the long of the same bits, per row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            values = np.array([fingerprint(text) for text in text_bytes(part)], np.uint64)
            yield batch(doc_id=part.column("doc_id"), print=values.view(np.int64))

    return arrow_map(texts(docs), work, "doc_id long, print long")


def _keyed(prints: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1 << 18):
            own = part.column("print").to_numpy().view(np.uint64)
            row, key = fuzzy_keys(own)
            yield batch(key=key, print=own[row].view(np.int64))

    return arrow_map(prints, work, "key long, print long")


def _met(keyed: DataFrame) -> DataFrame:
    """Edges between fingerprints that share a key and link: within a key, each to the least it reaches there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, starts in sorted_runs(batches, "key"):
            key, own = columns["key"], np.ascontiguousarray(columns["print"]).view(np.uint64)
            first, second = [], []
            for step in range(1, int(np.diff(starts).max())):
                near = (key[step:] == key[:-step]) & (np.bitwise_count(own[step:] ^ own[:-step]) <= ERRORS)
                at = np.flatnonzero(near)
                first.append(at)
                second.append(at + step)
            if not first:
                continue
            a, b = np.concatenate(first), np.concatenate(second)
            least, before = np.arange(len(own)), None
            while before is None or (least != before).any():
                before = least.copy()
                low = np.minimum(least[a], least[b])
                np.minimum.at(least, a, low)
                np.minimum.at(least, b, low)
                least = least[least]
            moved = np.flatnonzero(least != np.arange(len(own)))
            yield batch(a=own[moved].view(np.int64), b=own[least[moved]].view(np.int64))

    ordered = keyed.repartition("key").sortWithinPartitions("key", "print")
    return arrow_map(ordered, work, "a long, b long")


def _midpoints(prints: DataFrame) -> DataFrame:
    """Edges between all given fingerprints that link, in linear work: two that differ in at most two bits both lie
    within one bit of a word between them, and no word has more than 65 within one bit of it."""
    around = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda k: F.when(k == 64, F.col("print")).otherwise(
        F.col("print").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int")))
    ))
    placed = prints.select("print", F.explode(around).alias("middle"))
    least = F.min("print").over(Window.partitionBy("middle"))
    return placed.select(F.col("print").alias("a"), least.alias("b")).where("a <> b").distinct()


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that join exactly the distinct fingerprints ``print`` within ``ERRORS`` bits of each other,
    directly or through others that link."""
    keyed = _keyed(prints)
    crowded = saved(keyed.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded")
    calm = join_checked(keyed, crowded, ["key"], "left_anti", 16)
    packed = saved(join_checked(keyed, crowded, ["key"], "left_semi", 16).select("print").distinct(), "packed")
    return _met(calm).unionByName(_midpoints(packed))


def near_duplicates(docs: DataFrame, crowd: int = CROWD, common: int = COMMON) -> DataFrame:
    """Per row its 64-bit fingerprint (16 hex digits) and the smallest ``doc_id`` reachable by links.

    Equal fingerprints are one class. Distinct ones are decoded segment by segment with the perfect Golay code:
    each gets some sixteen keys, any two that link share a key, and pairs of a key are compared in full. A key of
    more than ``crowd`` fingerprints, as many near copies make it, is left to the words between them, which find all
    of its links without comparing pairs. Only edges to the least of each key move on to the component search.

    Rows without words, null and empty texts among them, have fingerprint zero and are linked as any other. Whole
    texts are read, however long. Repeated rows are equal in everything. Rows without an id link others and have the
    component they reach, null if it holds no id; rows of one id with different texts are linked by their
    fingerprints alone. Other columns are left out.
    """
    spark = docs.sparkSession
    rows = saved(fingerprints(docs), "fingerprints")
    classes = saved(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    edges = saved(links(classes.select("print"), crowd), "links")
    found = saved(components(edges, spark), "reached").withColumnRenamed("id", "print")
    # Each class with its component, as long as that holds more than one fingerprint: those that reach a smaller
    # one, and the smallest.
    found = found.unionByName(found.select(F.col("component").alias("print"), "component").distinct())
    joined = found.join(classes.select("print", "least"), "print")
    smallest = joined.groupBy("component").agg(F.min("least").alias("smallest"))
    smallest = joined.join(smallest, "component").select("print", "smallest")
    named = classes.join(smallest, "print", "left").select(
        "print", "n", F.when(F.col("smallest").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id")
    )
    named = saved(named, "named")
    # A fingerprint of many rows would bring them all to one task: such ones are few and joined by themselves.
    often, seldom = (named.where(rule).select("print", "component_id") for rule in (F.col("n") > common, F.col("n") <= common))
    few = join_checked(rows, often, ["print"], "left_anti", 16)
    told = join_checked(few, seldom, ["print"], "inner", 24).unionByName(join_checked(rows, often, ["print"], "inner", 24))
    return told.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
