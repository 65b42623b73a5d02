"""Toxicity from two class-conditional Kneser-Ney models with a shared backoff."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegraph.llm.common import WordHashes, arrow_map, as_long, batch, join_checked, lists, mixed, pieces, saved, text_bytes, texts
from tablegraph.llm.quality import held_out

#: Absolute discount of a class's counts: so few uses tell nothing of the class, and their mass goes to the
#: backoff that both classes share.
DISCOUNT = 16.0
#: Absolute discount of the shared counts.
SHARED_DISCOUNT = 0.75
#: A weight from which on one word speaks for the toxic class by itself.
STRONG = 1.5
#: Bytes of a word that make its stem: endings and second parts of compounds say little and make words rare.
STEM = 6
#: Counts below this give their mass to the backoff, as usual in n-gram models.
LEAST_COUNT = 2
#: The weights are broadcast while they stay below this; beyond it words are joined to them.
MODEL_BYTES = 64 << 20
#: Rows that fit the calibration; more labelled rows are thinned to about this many by the hash of their id.
CALIBRATION_ROWS = 200_000
#: Word pairs a task gathers before it combines them.
GATHERED = 2_000_000
#: Bytes of text whose keys a task looks up at once: three keys a word and their places, up to 40 bytes a byte.
LOOKED_UP = 1 << 20
_SPACED = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in bytes(range(256)).lower())
_START = np.uint64(0x5BD1E9955BD1E995)


def words_of(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Hashes of the stems of the runs of letters, A-Z in lower case; a stem that repeats at once counts once."""
    v = hashes.of([word[:STEM] for word in text.lower().translate(_SPACED).split()])
    return v[np.r_[True, v[1:] != v[:-1]]] if len(v) else v


def _sequences(v: np.ndarray) -> np.ndarray:
    return np.r_[_START, v[:-1]] if len(v) else v


def _pair_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mixed(u * np.uint64(0x9E3779B97F4A7C15) + v)


def _word_key(v: np.ndarray) -> np.ndarray:
    return mixed(v ^ np.uint64(0x1111111111111111))


def _context_key(u: np.ndarray) -> np.ndarray:
    return mixed(u ^ np.uint64(0x2222222222222222))


def pair_counts(labelled: DataFrame) -> DataFrame:
    """(u, v, pair, n1, n0): how often word v follows u in toxic and in ordinary texts.

    ``labelled``: text, label. Each task combines what it counts before the shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        size = 0

        def out() -> pa.RecordBatch:
            u, v = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            label = np.concatenate([np.full(len(h[0]), h[2]) for h in held])
            pair = _pair_key(u, v)
            _, first, place = np.unique(pair, return_index=True, return_inverse=True)
            n1 = np.bincount(place, weights=label, minlength=len(first)).astype(np.int64)
            n = np.bincount(place, minlength=len(first))
            return batch(u=as_long(u[first]), v=as_long(v[first]), n1=n1, n0=n - n1)

        for part in pieces(batches):
            for text, label in zip(text_bytes(part), part.column("label").to_pylist(), strict=True):
                v = words_of(text, hashes)
                held.append((_sequences(v), v, label))
                size += len(v)
            if size >= GATHERED:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    counted = arrow_map(labelled, work, "u long, v long, n1 long, n0 long")
    return counted.groupBy("u", "v").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def weights(pairs: DataFrame, discount: float = DISCOUNT, least: int = LEAST_COUNT) -> tuple[DataFrame, float]:
    """The difference of the two models' log-likelihoods as a table of additive weights, and that of an unknown word.

    In each class an interpolated Kneser-Ney bigram backs off to the class's continuation counts (in how many
    contexts a word stands), and these to the continuation counts of both classes together and to a uniform
    share. A pair that is not kept has the sum of a weight of its context and one of its word; a kept pair
    has a correction to that sum. So each lookup stands alone, and any split of the table gives the same sum.
    """
    d = F.lit(float(discount))

    def less(count: Column) -> Column:
        return F.greatest(count - d, F.lit(0.0))

    def taken(count: Column) -> Column:
        return F.least(count.cast("double"), d)

    contexts = saved(
        pairs.groupBy("u").agg(
            *[F.sum(f"n{c}").cast("double").alias(f"all{c}") for c in (0, 1)],
            *[F.sum(taken(F.col(f"n{c}"))).alias(f"taken{c}") for c in (0, 1)],
        ),
        "contexts",
    )
    words = saved(
        pairs.groupBy("v").agg(
            F.count("*").cast("double").alias("shared"),
            *[F.sum((F.col(f"n{c}") > 0).cast("double")).alias(f"cont{c}") for c in (0, 1)],
        ),
        "words",
    )
    total = words.agg(
        F.count("*").alias("kinds"),
        F.sum("shared").alias("shared"),
        *[F.sum(f"cont{c}").alias(f"cont{c}") for c in (0, 1)],
        *[F.sum(taken(F.col(f"cont{c}"))).alias(f"taken{c}") for c in (0, 1)],
    ).first()
    uniform = SHARED_DISCOUNT * total["kinds"] / total["shared"] / (total["kinds"] + 1)
    rest = {c: total[f"taken{c}"] / total[f"cont{c}"] for c in (0, 1)}
    unknown = float(np.log(rest[1]) - np.log(rest[0]))

    def low(c: int) -> Column:
        shared = F.greatest(F.col("shared") - F.lit(SHARED_DISCOUNT), F.lit(0.0)) / F.lit(total["shared"]) + F.lit(uniform)
        return less(F.col(f"cont{c}")) / F.lit(total[f"cont{c}"]) + F.lit(rest[c]) * shared

    known = words.where(F.col("shared") >= least).select("v", low(0).alias("low0"), low(1).alias("low1"))
    word_weight = F.log("low1") - F.log("low0")
    # A context never met in a class backs off with its whole mass.
    back = {c: F.when(F.col(f"all{c}") > 0, F.col(f"taken{c}") / F.col(f"all{c}")).otherwise(F.lit(1.0)) for c in (0, 1)}
    lean = contexts.where(F.col("all0") + F.col("all1") >= least).select(
        "u", "all0", "all1", back[0].alias("back0"), back[1].alias("back1")
    )
    context_weight = F.log("back1") - F.log("back0")
    kept = pairs.where(F.col("n0") + F.col("n1") >= least).join(known, "v").join(lean, "u")

    def high(c: int) -> Column:
        own = F.when(F.col(f"all{c}") > 0, less(F.col(f"n{c}")) / F.col(f"all{c}")).otherwise(F.lit(0.0))
        return F.log(own + F.col(f"back{c}") * F.col(f"low{c}"))

    keyed = [
        (known.select("v", (word_weight - F.lit(unknown)).alias("w")), lambda p: _word_key(p["v"])),
        (lean.select("u", context_weight.alias("w")), lambda p: _context_key(p["u"])),
        (
            kept.select("u", "v", (high(1) - high(0) - word_weight - context_weight).alias("w")),
            lambda p: _pair_key(p["u"], p["v"]),
        ),
    ]

    def with_key(rows: DataFrame, make) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                hashed = {c: part.column(c).to_numpy().view(np.uint64) for c in part.schema.names if c != "w"}
                yield batch(key=as_long(make(hashed)), weight=part.column("w").cast(pa.float32()))

        return arrow_map(rows, work, "key long, weight float")

    table = None
    for rows, make in keyed:
        part = with_key(rows, make)
        table = part if table is None else table.unionByName(part)
    # An unknown word's weight is counted for every word, so known words carry the difference.
    return saved(table, "weights"), unknown


def _keys(text: bytes, hashes: WordHashes) -> tuple[np.ndarray, int]:
    v = words_of(text, hashes)
    u = _sequences(v)
    return np.concatenate([_word_key(v), _context_key(u), _pair_key(u, v)]) if len(v) else v, len(v)


def totals(docs: DataFrame, table: DataFrame, limit: int = MODEL_BYTES) -> DataFrame:
    """(doc_id, total, strong, n): the summed weights, the sum of the strong ones, and the words of every whole text."""
    if table.count() * 12 <= limit:
        return _totals_by_broadcast(docs, table)
    return _totals_by_join(docs, table)


def _totals_by_broadcast(docs: DataFrame, table: DataFrame) -> DataFrame:
    model = table.toArrow()  # counted before, so within the limit
    keys = model.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], model.column("weight").to_numpy()[order]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _looked_up(batches, *shared.value)

    return arrow_map(texts(docs), work, "doc_id long, total double, strong double, n long")


def _looked_up(batches: Iterator[pa.RecordBatch], known: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The totals of the texts by the sorted keys ``known`` and their weights."""
    hashes = WordHashes()
    for part in pieces(batches, LOOKED_UP):
        found = [_keys(text, hashes) for text in text_bytes(part)]
        flat = np.concatenate([k for k, _ in found])
        owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(k) for k, _ in found])
        # Looked up in order, neighbours lie in the same part of memory.
        order = np.argsort(flat)
        flat, owner = flat[order], owner[order]
        at = np.searchsorted(known, flat) if len(known) else np.zeros(len(flat), np.int64)
        at[at == len(known)] = 0
        hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
        owner, own = owner[hit], weight[at[hit]].astype(np.float64)
        total = np.bincount(owner, weights=own, minlength=len(found))
        strong = np.bincount(owner, weights=np.where(own >= STRONG, own, 0.0), minlength=len(found))
        n = pa.array([n for _, n in found], pa.int64())
        yield batch(doc_id=part.column("doc_id"), total=total, strong=strong, n=n)


def _totals_by_join(docs: DataFrame, table: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in pieces(batches, LOOKED_UP):
            found = [_keys(text, hashes) for text in text_bytes(part)]
            yield batch(
                row=part.column("row"), doc_id=part.column("doc_id"), n=pa.array([n for _, n in found], pa.int64()),
                keys=lists([k for k, _ in found]),
            )

    numbered = texts(docs).withColumn("row", F.monotonically_increasing_id())
    keyed = arrow_map(numbered, work, "row long, doc_id long, n long, keys array<long>")
    rows = keyed.select("row", "doc_id", "n", F.explode_outer("keys").alias("key"))
    joined = rows.join(table, "key", "left")
    own = F.col("weight").cast("double")
    summed = joined.groupBy("row", "doc_id", "n").agg(
        F.coalesce(F.sum(own), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.when(own >= STRONG, own)), F.lit(0.0)).alias("strong"),
    )
    return summed.select("doc_id", "total", "strong", "n")


def _features() -> list[Column]:
    n = F.greatest("n", F.lit(1))
    return [F.col("total") / n, F.col("total") / F.sqrt(n), F.log1p("strong"), F.log1p(F.col("strong") * 100 / n)]


def _calibrate(rows: list, rounds: int = 30, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression of the label on the standardised length-normalised differences."""
    x = np.array([row["x"] for row in rows], float)
    y = np.array([row["label"] for row in rows], float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w))
        w -= np.linalg.solve(hessian, z.T @ (p - y) + ridge * len(x) * w)
    return w, mean, scale


def score(
    docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, threshold: float = 0.7, model_bytes: int = MODEL_BYTES
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``.

    Of the labelled rows that are not held out, one half (the next remainder) counts the language models,
    over whole texts and all rows, and the other fits a logistic curve on the length-normalised difference of
    their log-likelihoods, on at most about ``CALIBRATION_ROWS`` rows. The models are aggregated and joined
    as tables; only while all weights together stay within ``model_bytes`` are they sent to the tasks.

    Empty and null texts have no evidence and are scored by the curve at zero. Null ids are scored, never
    learned from; of several labels of a document the smallest counts; repeated rows are scored each. Where
    one class has no text to learn from, every score is 0.5.
    """
    spark = docs.sparkSession
    known = saved(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label")),
        "labels",
    )
    parts = [r for r in range(modulus) if r != remainder]
    learning = known.where(held_out(modulus, parts[0]))
    learning = saved(learning, "learning")
    pairs = saved(pair_counts(join_checked(texts(docs), learning, ["doc_id"], "inner", 24).select("text", "label")), "pairs")
    seen = pairs.agg(F.sum("n0"), F.sum("n1")).first()
    plain = texts(docs).select("doc_id", held_out(modulus, remainder).alias("held_out"))
    nothing = plain.withColumn("score", F.lit(0.5)).withColumn("predicted", F.lit(0))
    if not seen[0] or not seen[1]:
        return nothing
    table, unknown = weights(pairs)
    summed = totals(docs, table, model_bytes)
    scored = saved(summed.withColumn("total", F.col("total") + F.col("n") * F.lit(unknown)), "totals")
    fitting = saved(known.where(~held_out(modulus, remainder) & ~held_out(modulus, parts[0])), "fitting")
    n = fitting.count()
    if n > CALIBRATION_ROWS:
        fitting = fitting.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * CALIBRATION_ROWS / n)))
    rows = join_checked(scored, saved(fitting, "fitted"), ["doc_id"], "inner", 24)
    rows = rows.select(F.array(*_features()).alias("x"), "label").orderBy("x", "label").collect()
    if len({row["label"] for row in rows}) < 2:
        return nothing
    w, mean, scale = _calibrate(rows)
    z = F.lit(float(w[-1]))
    for k, x in enumerate(_features()):
        z = z + F.lit(float(w[k])) * (x - F.lit(float(mean[k]))) / F.lit(float(scale[k]))
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return scored.select(
        "doc_id",
        held_out(modulus, remainder).alias("held_out"),
        probability.alias("score"),
        (probability >= F.lit(threshold)).cast("int").alias("predicted"),
    )
