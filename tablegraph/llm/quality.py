"""Quality classifier: a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegraph.llm.common import (
    WordHashes,
    arrow_map,
    batch,
    join_checked,
    pieces,
    saved,
    shingles,
    text_bytes,
    texts,
)

#: Statistics, in the order of their vector.
STATISTICS = (
    "log_words", "log_word_bytes", "symbols", "capitals", "digits", "marks",
    "repeats_before", "repeated_windows", "repeated_lines", "rare_letters",
)
_SYMBOLS = b"#*$%&|<>{}[]\\^~=_@"
_MARKS = b"!?"
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
#: Added to each variance, so that a statistic that never varies in a class can't decide alone.
FLOOR = 0.03


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is not held out."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(modulus) == F.lit(remainder), F.lit(False))


def _count(text: bytes, which: bytes) -> int:
    return len(text) - len(text.translate(None, which))


def statistics(text: bytes, hashes: WordHashes) -> list[float]:
    """Transformed statistics of one whole text; shares are square roots, so that small ones differ visibly."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = sum(map(len, words))
    letters = max(1, _count(text, _LETTERS))
    coded = hashes.of(words)
    grams = shingles(coded)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return [
        np.log1p(n),
        np.log(size / n),
        (_count(text, _SYMBOLS) / size) ** 0.5,
        (_count(text, _CAPITALS) / letters) ** 0.5,
        (_count(text, _DIGITS) / size) ** 0.5,
        (_count(text, _MARKS) / size) ** 0.5,
        (np.count_nonzero(coded[1:] == coded[:-1]) / n) ** 0.5,
        (1 - len(np.unique(grams)) / len(grams)) ** 0.5,
        (1 - len(set(lines)) / len(lines)) ** 0.5 if lines else 0.0,
        (1 - letters / size if letters < size else 0.0) ** 0.5,
    ]


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics ``x`` of every whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in pieces(batches):
            rows = [statistics(text, hashes) for text in text_bytes(part)]
            yield batch(doc_id=part.column("doc_id"), x=pa.array(rows, pa.list_(pa.float64())))

    return arrow_map(texts(docs), work, "doc_id long, x array<double>")


class Discriminant:
    """Class means and Cholesky factors of shrunk class covariances, with class shares."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float, pool: float):
        """``moments``: rows, sum and sum of outer products by class."""
        total = sum(n for n, _, _ in moments.values())
        covariances = {c: s2 / n - np.outer(s / n, s / n) for c, (n, s, s2) in moments.items()}
        pooled = sum(n * covariances[c] for c, (n, _, _) in moments.items()) / total
        self.parts = {}
        for c, (n, s, _) in moments.items():
            own = (1 - pool) * covariances[c] + pool * pooled
            own = (1 - shrink) * own + shrink * np.diag(np.diag(own)) + FLOOR**2 * np.eye(len(s))
            factor = np.linalg.cholesky(own)
            self.parts[c] = (s / n, factor, np.log(n / total) - np.log(np.diag(factor)).sum())

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 per row of ``x``."""
        log_density = {}
        for c, (mean, factor, constant) in self.parts.items():
            z = np.linalg.solve(factor, (x - mean).T)
            log_density[c] = constant - 0.5 * np.einsum("ij,ij->j", z, z)
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -60, 60)))


def _moments(rows: DataFrame, dims: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Sums per class over all labelled rows, in one aggregation with a combine."""
    pairs = [(i, j) for i in range(dims) for j in range(i + 1)]
    x = [F.col("x")[i] for i in range(dims)]
    sums = rows.groupBy("label").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(v) for v in x]).alias("s"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("s2"),
    )
    out = {}
    for row in sums.collect():  # one row per class
        s2 = np.zeros((dims, dims))
        for (i, j), value in zip(pairs, row["s2"], strict=True):
            s2[i, j] = s2[j, i] = value
        out[row["label"]] = (row["n"], np.array(row["s"]), s2)
    return out


def classified(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    modulus: int = 4,
    remainder: int = 2,
    shrink: float = 0.1,
    pool: float = 0.1,
    threshold: float = 0.7,
) -> tuple[DataFrame, bool]:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``, and whether a model was fitted.

    Statistics of all texts are computed once and saved; class means and covariances are sums over all
    labelled rows that are not held out, so training is one aggregation whatever the size. Only the class
    moments reach the driver. Null and empty texts have zero statistics and are scored with them. Null ids
    are scored but never learned from; of several labels of a document the smallest counts; a document
    repeated in ``docs`` is scored and learned from each time. Where a class has fewer than two labelled
    rows no model is fitted and every score is 0.5.
    """
    rows = saved(features(docs), "statistics")
    known = saved(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label")),
        "labels",
    )
    learned = join_checked(rows.where(~held_out(modulus, remainder)), known, ["doc_id"], "inner", 48)
    moments = _moments(learned, len(STATISTICS))
    able = set(moments) == {0, 1} and min(n for n, _, _ in moments.values()) >= 2
    model = Discriminant(moments, shrink, pool) if able else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            score = model.scores(x) if model else np.full(len(x), 0.5)
            yield batch(doc_id=part.column("doc_id"), score=score)

    scored = arrow_map(rows, work, "doc_id long, score double").select(
        "doc_id",
        held_out(modulus, remainder).alias("held_out"),
        "score",
        (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"),
    )
    return scored, able


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``classified`` alone."""
    return classified(docs, labels, **options)[0]
