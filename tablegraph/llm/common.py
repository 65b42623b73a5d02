"""Helpers shared by the operators: inputs, saved tables, checked joins, word hashes, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tablegraph.llm
from tablegraph.session import work_path

# Task functions travel to the executors as they are, so this package need not be installed there.
cloudpickle.register_pickle_by_value(tablegraph.llm)

#: A join side is broadcast only when its counted rows stay below this many bytes.
BROADCAST_BYTES = 32 << 20
#: Bytes of a batch sent to a task function; by its number of rows alone a batch of long texts would be far larger.
BATCH_BYTES = 4 << 20
#: Words of a shingle.
SHINGLE = 5
#: Distinct words a task remembers the hash of before it starts afresh: some 200 bytes each.
REMEMBERED_WORDS = 200_000


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; a null text is empty. Other columns, whatever their names, stay out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared work folder and read again: its lineage ends there."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_checked(
    big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int, limit: int = BROADCAST_BYTES
) -> DataFrame:
    """Join, broadcasting ``small`` when its counted rows are within ``limit`` bytes, shuffling otherwise.

    ``small`` should be a saved table, so that counting it is cheap.
    """
    fits = small.count() * row_bytes <= limit
    return big.join(F.broadcast(small) if fits else small, on, how)


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str):
    """``work`` over batches of at most about ``BATCH_BYTES``; a task gives back what it held when it ends.

    Python workers live on from stage to stage, and so do the buffers that an executor filled for them.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        _POWERS.clear()
        release_memory()

    return df.mapInArrow(task, schema)


def release_memory() -> None:
    """Hands free memory of this process back to the system, which neither Arrow nor malloc does by itself."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: Bytes of a text hashed at once, at word ends.
HASHED_BYTES = 1 << 20
_BYTE_HASHES = np.random.default_rng(20_240_602).integers(1, 1 << 64, 256, dtype=np.uint64)
_IS_WORD = np.array([byte not in b" \t\n\v\f\r" for byte in range(256)])


def wrapping_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers at least of an odd number, modulo 2 ** 64, and their inverses."""
    return _POWERS[1 << max(19, n.bit_length())]  # few sizes, so that a task makes them once


class _Powers(dict):
    """``wrapping_powers`` by size, two sizes at most; it travels to a task empty, and not by the name of this module."""

    def __missing__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > 1:
            self.clear()
        step = 0x9E3779B97F4A7C15
        self[n] = tuple(
            np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64) for base in (step, pow(step, -1, 1 << 64))
        )
        return self[n]

    def __reduce__(self):
        return _Powers, ()


_POWERS = _Powers()


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``word_bytes``, in order, from sums of powers over all bytes."""
    return _hashed(text)[0]


def word_hashes_of(texts_of: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of many texts, one behind the other, and how many words each text has."""
    hashes, starts = _hashed(b"\n".join(texts_of))
    ends = np.cumsum([len(text) + 1 for text in texts_of])
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of a text and where the words start."""
    raw = np.frombuffer(text.lower(), np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    _IS_WORD.take(raw, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + HASHED_BYTES, "right")))
        n = int(ends[to - 1] - low)
        powers, inverse = wrapping_powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_HASHES.take(raw[low : low + n]) * powers[:n], out=sums[1:])
        first, past = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[past] - sums[first]) * inverse[first]
        at = to
    return mixed(out), starts


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection, so no two values meet)."""
    v = values ^ (values >> np.uint64(31))
    v = v * np.uint64(0x9E3779B97F4A7C15)
    v = v ^ (v >> np.uint64(29))
    v = v * np.uint64(0xBF58476D1CE4E5B9)
    return v ^ (v >> np.uint64(32))


_STEP = np.uint64(0x100000001B3 * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF | 1)


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A hash per run of ``width`` words, in order; a shorter sequence is one shingle as a whole."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    last = n - width + 1
    total = hashes[:last].copy()
    for k in range(1, width):
        total = total * _STEP + hashes[k : last + k]
    return mixed(total + np.uint64(width))


def word_bytes(text: bytes) -> list[bytes]:
    """A-Z in lower case, cut at the six ASCII white-space characters."""
    return text.lower().split()


def as_long(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the longs of the same bits."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def lists(values: list[np.ndarray]) -> pa.ListArray:
    """One list of longs per element."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), as_long(flat))


def batch(**columns) -> pa.RecordBatch:
    """A record batch from Arrow arrays, numpy arrays or lists by name."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def text_bytes(rows: pa.RecordBatch, name: str = "text") -> list[bytes]:
    column = rows.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``limit`` bytes, one row at least."""
    for rows in batches:
        step = max(1, int(rows.num_rows * limit / max(1, rows.nbytes)))
        for at in range(0, rows.num_rows, step):
            yield rows.slice(at, step)


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[dict, np.ndarray]]:
    """Sorted batches as (columns, starts of runs of equal ``key``); a run cut by a batch's end is carried over.

    The columns are numpy arrays; the last element of starts is the number of rows.
    """
    held: pa.Table | None = None
    for rows in batches:
        table = pa.Table.from_batches([rows])
        table = table if held is None else pa.concat_tables([held, table])
        keys = table.column(key).to_numpy()
        if len(keys) == 0:
            continue
        cut = int(np.searchsorted(keys, keys[-1], side="left")) if keys[0] != keys[-1] else 0
        held = table.slice(cut)
        if cut:
            yield _runs(table.slice(0, cut), key)
    if held is not None and held.num_rows:
        yield _runs(held, key)


def _runs(table: pa.Table, key: str) -> tuple[dict, np.ndarray]:
    columns = {
        name: table.column(name).to_numpy()
        if not pa.types.is_nested(table.schema.field(name).type) and not pa.types.is_binary(table.schema.field(name).type)
        else table.column(name).combine_chunks()
        for name in table.column_names
    }
    keys = columns[key]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return columns, np.r_[starts, len(keys)]


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """The smallest id reachable from each id of ``edges`` (a, b: long): (id, component).

    Alternating stars: every id hands its larger neighbours, then its smaller ones, to its smallest
    neighbour, until nothing changes. Each round is two aggregations with a combine and two joins,
    written to the shared folder; nothing is gathered in one task or on the driver.
    """

    def stamp(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        return tuple(row)

    # a > b throughout.
    edges = saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = stamp(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.unionByName(edges.join(least, "a").select("a", F.col("m").alias("b"))).distinct(), "star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = least.select("a", F.col("m").alias("b"))
        edges = saved(kept.unionByName(moved).where("a <> b").distinct(), "star")
        after = stamp(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
