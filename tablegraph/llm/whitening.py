"""Whitening of embeddings along the leading eigenvectors of their covariance, found by spectrum slicing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegraph.llm.common import arrow_map, batch, pieces, saved

#: Components returned.
COMPONENTS = 4
#: Entries are cut to multiples of one in so many.
SCALE = 256
#: Rounds of Rayleigh quotient iteration; it converges cubically, so few are ever used.
ROUNDS = 40

SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def inertia(matrix: np.ndarray, shift: float) -> int:
    """The number of eigenvalues above ``shift``: positive pivots of the LDLᵀ factors of ``matrix - shift``
    (Bunch-Kaufman pivots of one or two rows; Sylvester's law of inertia). An exact zero pivot counts as not above."""
    a = matrix - shift * np.eye(len(matrix))
    above, choice = 0, (1 + 17**0.5) / 8
    while len(a):
        n, pair = len(a), False
        if n > 1:
            column = np.abs(a[1:, 0])
            far = int(column.argmax()) + 1
            largest = column[far - 1]
            if largest and abs(a[0, 0]) < choice * largest:
                row = np.abs(a[far])
                row[far] = 0.0
                if abs(a[0, 0]) * row.max() < choice * largest**2:
                    other = 0 if abs(a[far, far]) >= choice * row.max() else 1
                    pair = other == 1
                    order = np.arange(n)  # the pivot comes first, or second beside the first row
                    order[[other, far]] = order[[far, other]]
                    a = a[np.ix_(order, order)]
        if pair:
            block, rest = a[:2, :2], a[2:, :2]
            above += int((np.linalg.eigvalsh(block) > 0).sum())
            a = a[2:, 2:] - rest @ np.linalg.solve(block, rest.T)
        else:
            pivot, rest = a[0, 0], a[1:, 0]
            above += int(pivot > 0)
            a = a[1:, 1:] - np.outer(rest, rest / pivot) if pivot else a[1:, 1:]
    return above


def rayleigh(matrix: np.ndarray, start: float, known: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """An eigenvalue near ``start`` and its unit vector, orthogonal to the ``known`` ones: Rayleigh quotient
    iteration after two steps with the shift held, the shift moved by the quotient until it stands still."""
    n = len(matrix)
    tiny = np.finfo(float).eps * max(np.abs(matrix).max(), np.finfo(float).tiny)
    rng = np.random.default_rng(n)
    value, best = start, (np.inf, start, None)
    vector = rng.standard_normal(n)
    for round_ in range(ROUNDS):
        for other in known:
            vector = vector - other * (other @ vector)
        vector = vector / np.linalg.norm(vector)
        if round_ > 2:
            value = float(vector @ matrix @ vector)
            error = float(np.linalg.norm(matrix @ vector - value * vector))
            if error < best[0]:
                best = (error, value, vector)
            elif error <= 64 * tiny * n:
                break
        shifted = matrix - value * np.eye(n)
        try:
            solved = np.linalg.solve(shifted, vector)
        except np.linalg.LinAlgError:
            solved = np.linalg.solve(shifted + tiny * np.eye(n), vector)
        if not np.isfinite(solved).all():
            solved = np.linalg.solve(shifted + 8 * tiny * np.eye(n), vector)
        vector = solved / np.linalg.norm(solved)
    return best[1], best[2]


def leading(matrix: np.ndarray, most: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """(eigenvalue, unit vector) of the ``most`` largest eigenvalues, by falling value.

    Inertia counts halve an interval until it holds the wanted eigenvalue alone, or until equal ones can't be told
    apart; iteration from its middle must end inside, and counts on both sides of the end certify the number, else
    the interval is halved further. Eigenvalues that are zero to rounding are left out. The largest entry of each
    vector is positive.
    """
    bound = float(np.abs(matrix).sum(axis=1).max()) if len(matrix) else 0.0
    # Below this an eigenvalue of the matrix as summed is rounding.
    slack = 8 * len(matrix) * np.finfo(float).eps * bound
    found: list[tuple[float, np.ndarray]] = []
    if not bound:
        return found
    for number in range(1, min(most, inertia(matrix, slack)) + 1):
        # At least ``number`` eigenvalues lie above low, fewer above high.
        low, high = slack, bound * 1.0000001
        below, over = inertia(matrix, low), 0
        while True:
            while below - over > 1 and high - low > slack:
                middle = (low + high) / 2
                count = inertia(matrix, middle)
                if count >= number:
                    low, below = middle, count
                else:
                    high, over = middle, count
            value, vector = rayleigh(matrix, (low + high) / 2, [v for _, v in found])
            narrow = high - low <= slack
            certain = inertia(matrix, value + slack) < number <= inertia(matrix, value - slack)
            if narrow or low <= value <= high and certain:
                break
            middle = (low + high) / 2
            count = inertia(matrix, middle)
            if count >= number:
                low, below = middle, count
            else:
                high, over = middle, count
        found.append((value, vector * np.sign(vector[np.abs(vector).argmax()])))
    return sorted(found, key=lambda pair: -pair[0])


def scaled(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``x``: the whole steps of each entry, for vectors without null or non-finite entries. Of vectors
    of several lengths only those of the commonest (the longest among equals) are kept, and no empty ones."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    largest = F.lit(float("inf"))
    sound = own.where(
        F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < largest))
    )
    lengths = sound.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return own.where("false").select("vec_id", F.col("c").cast("array<long>").alias("x"))
    return sound.where(F.size("c") == lengths["d"]).select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE)).alias("x"))


def _rows(part: pa.RecordBatch) -> np.ndarray:
    values = part.column("x")
    return values.flatten().to_numpy().reshape(part.num_rows, -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` as whole numbers, in Python's own where longs could overflow."""
    most = max(abs(int(x.min())), abs(int(x.max())), 1) if x.size else 1
    wide = n * most + max(map(abs, sums)) >= 1 << 62
    return x.astype(object) * n - np.array(sums, object) if wide else x * n - np.array(sums, np.int64)


def _summed(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all partitions of the matrix that ``of`` makes of a block of rows, row by row of it: each
    partition gives one matrix, and its rows are added up by their place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in pieces(batches):
            if part.num_rows:
                made = of(_rows(part))
                total = made if total is None else total + made
        if total is not None:
            yield batch(place=np.arange(len(total), dtype=np.int32), row=pa.array(list(total), pa.list_(pa.float64())))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for part in batches:
            rows = part.column("row").flatten().to_numpy().reshape(part.num_rows, -1)
            for place, row in zip(part.column("place").to_pylist(), rows, strict=True):
                totals[place] = totals[place] + row if place in totals else row
        if totals:
            yield batch(place=pa.array(list(totals), pa.int32()), row=pa.array(list(totals.values()), pa.list_(pa.float64())))

    schema = "place int, row array<double>"
    rows = arrow_map(arrow_map(fit, partial, schema).repartition("place"), add, schema).collect()
    return np.array([row["row"] for row in sorted(rows, key=lambda row: row["place"])])


def sums_of(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, None
        for part in pieces(batches):
            if part.num_rows:
                x = _rows(part)
                safe = part.num_rows * max(abs(int(x.min())), abs(int(x.max()))) < 1 << 62
                made = (x if safe else x.astype(object)).sum(axis=0).astype(object)
                count, total = count + part.num_rows, made if total is None else total + made
        if total is not None:
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield batch(place=np.arange(len(total), dtype=np.int32), n=np.full(len(total), count, np.int64), s=values)

    rows = arrow_map(fit, partial, "place int, n long, s decimal(38,0)").groupBy("place")
    rows = rows.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("place").collect()
    return (rows[0]["n"] if rows else 0), [int(row["s"]) for row in rows]


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per sound vector and leading component: exact squared deviation from the mean, and the whitened coordinate.

    Each distinct vector of whole steps counts once in the mean and the covariance, so copies weigh nothing. The
    exact sums and then the centred products are added up over partitions; only matrices as wide as a vector reach
    the driver, which slices their spectrum (``leading``). A third pass measures how far the whitened vectors'
    covariance is from the identity. The last pass projects every row.

    Vectors that are null, empty or hold null or non-finite entries give no row, nor do those of another length than
    the commonest. Repeated rows, ids or not, are each returned. Components without variance are left out: with fewer
    than two distinct vectors no row is returned. Entries past a long's range stand at its end; a deviation that no
    long can hold is null. Other columns are left out. Empty table: no rows.
    """
    spark = vectors.sparkSession
    rows = saved(scaled(vectors), "scaled")
    fit = saved(rows.select("x").distinct(), "fit")
    n, sums = sums_of(fit)
    if not n:
        return spark.createDataFrame([], SCHEMA)

    def spread(x: np.ndarray) -> np.ndarray:
        c = (centred(x, n, sums) / n).astype(float)
        return c.T @ c

    covariance = _summed(fit, spread) / n
    covariance = (covariance + covariance.T) / 2
    pairs = leading(covariance, most)
    if not pairs:
        return spark.createDataFrame([], SCHEMA)
    values = np.array([value for value, _ in pairs])
    basis = np.stack([vector for _, vector in pairs], axis=1) / np.sqrt(values)
    explained = values / np.trace(covariance)

    def again(x: np.ndarray) -> np.ndarray:
        w = (centred(x, n, sums) / n).astype(float) @ basis
        return w.T @ w

    identity_error = float(np.abs(_summed(fit, again) / n - np.eye(len(pairs))).max())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(pairs)
        for part in pieces(batches, 4 << 20):
            if not part.num_rows:
                continue
            c = centred(_rows(part), n, sums)
            most_ = max(abs(int(c.min())), abs(int(c.max())))
            safe = most_**2 * c.shape[1] < 1 << 62
            squares = ((c if safe else c.astype(object)) ** 2).sum(axis=1)
            deviation = [v if -(1 << 63) <= v < 1 << 63 else None for v in squares.tolist()]
            projected = (c / n).astype(float) @ basis
            yield batch(
                vec_id=part.column("vec_id").take(pa.array(np.repeat(np.arange(part.num_rows), k))),
                component=np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows),
                n=np.full(part.num_rows * k, n, np.int64),
                deviation=pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(part.num_rows), k))),
                whitened=projected.ravel(),
                explained=np.tile(explained, part.num_rows),
                identity_error=np.full(part.num_rows * k, identity_error),
            )

    return arrow_map(rows, work, SCHEMA)
