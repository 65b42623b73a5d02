"""Whitening against a dense eigensolver, and its parts on matrices with equal, close and zero eigenvalues."""

import numpy as np
import pytest

from tablegraph.llm import whitening
from tablegraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40])
def test_inertia_counts_eigenvalues_above_the_shift(size):
    rng = np.random.default_rng(size)
    for _ in range(30):
        matrix = rng.standard_normal((size, size))
        matrix = matrix + matrix.T
        if rng.random() < 0.5:
            np.fill_diagonal(matrix, 0)  # no pivot of one row to begin with
        shift = float(rng.standard_normal())
        assert whitening.inertia(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [5, 5, 5, 5, 1], [5, 5 - 1e-10, 5 - 2e-10, 1, 1], [5, 4, 0, 0, 0], [1e-6, 1e-7, 1e-8, 1e-9, 0],
    [7, 1, 1, 1, 1], [3], [2, 2],
])
def test_leading_pairs_are_eigenpairs_in_order(values):
    rng = np.random.default_rng(len(values))
    turn = np.linalg.qr(rng.standard_normal((len(values),) * 2))[0]
    matrix = (turn * np.array(values, float)) @ turn.T
    matrix = (matrix + matrix.T) / 2
    pairs = whitening.leading(matrix)
    assert len(pairs) == min(4, np.count_nonzero(values))
    for (value, vector), want in zip(pairs, values, strict=False):
        assert value == pytest.approx(want, rel=1e-9, abs=1e-14 * values[0])
        assert np.linalg.norm(matrix @ vector - value * vector) < 1e-12 * values[0]
    basis = np.stack([vector for _, vector in pairs])
    assert np.abs(basis @ basis.T - np.eye(len(pairs))).max() < 1e-9
    assert whitening.leading(np.zeros((3, 3))) == []


def brute(vectors):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, basis = np.linalg.eigh((fit - s / n).T @ (fit - s / n) / n)
    values, basis = values[::-1][:4], basis[:, ::-1][:, :4]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ basis / np.sqrt(values), values / np.trace((fit - s / n).T @ (fit - s / n) / n)


def test_query_agrees_with_a_dense_solver(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, explained = brute([row["embedding"] for row in table])
    rows = {(row["vec_id"], row["component"]): row for row in QUERIES["op12_embedding_whitening"](spark, SF).collect()}
    assert len(rows) == 4 * len(table)
    for k in range(4):
        own = [rows[row["vec_id"], k + 1] for row in table]
        got = np.array([row["whitened"] for row in own])
        sign = np.sign(got[0] * white[0, k])
        assert np.abs(got - sign * white[:, k]).max() < 1e-10
        assert [row["deviation"] for row in own] == deviation.tolist() and {row["n"] for row in own} == {n}
        assert own[0]["explained"] == pytest.approx(explained[k], rel=1e-10) and len({row["explained"] for row in own}) == 1
        assert max(row["identity_error"] for row in own) < 1e-9


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, x string, n long"
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    sound = [(k, rng.standard_normal(5).tolist(), None, "x", 1) for k in range(12)]
    copies = [(100 + k, sound[0][1], 1, None, None) for k in range(50)] + [(None, sound[1][1], 1, None, None)]
    bad = [(200, None, 0, "", 0), (201, [], 0, "", 0), (202, [1.0, None, 0.0, 0.0, 0.0], 0, "", 0), (203, [nan] * 5, 0, "", 0),
           (204, [inf, 0.0, 0.0, 0.0, 0.0], 0, "", 0), (205, [1.0, 2.0], 0, "", 0)]
    rows = whitening.whiten(spark.createDataFrame(sound + copies + bad, schema)).collect()
    kept = [np.array(v, np.float32) for _, v, *_ in sound]
    n, deviation, white, _ = brute(kept)
    by = {(row["vec_id"], row["component"]): row for row in rows}
    assert len(rows) == 4 * (len(sound) + len(copies)) and {row["n"] for row in rows} == {12} == {n}
    assert by[3, 2]["deviation"] == deviation[3] and abs(abs(by[3, 2]["whitened"]) - abs(white[3, 1])) < 1e-10
    assert by[100, 1]["whitened"] == by[0, 1]["whitened"] and by[None, 1]["whitened"] == by[1, 1]["whitened"]
    for few in ([], bad[:5], sound[:1] + copies[:3]):
        assert whitening.whiten(spark.createDataFrame(few, schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0], 0, "", 0), (2, [0.0, 3.0], 0, "", 0)], schema)).collect()
    assert sorted((row["vec_id"], row["component"], abs(row["whitened"]), row["explained"]) for row in line) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_entries_past_a_long_keep_their_place(spark):
    rows = [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {row["deviation"] for row in out if row["vec_id"] == 1} == {None} and out[0]["n"] == 3
