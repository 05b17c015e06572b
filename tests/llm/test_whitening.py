"""Whitening against numpy on the whole matrix, in several chunks, tasks and lengths, and in odd cases."""

from fractions import Fraction

import numpy as np
import pytest

from quizloom.llm import whitening as W
from quizloom.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>, x string, id string, component string"


def plain(x, k=4):
    """length n, {vector: deviation}, shares and whitened columns up to sign, by numpy's eigenvectors of the covariance."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [sum(c) for c in fit.T.tolist()]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    values, axes = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, deviation, values[:k] / values.sum(), ((x - mean) @ axes[:, :k]) / np.sqrt(values[:k])


def compared(found, x, ids):
    n, deviation, share, whitened = plain(x)
    for c in range(1, whitened.shape[1] + 1):
        own = found[(found.component == c) & found.id.isin(ids)].set_index("id").loc[ids]
        assert (own.n == n).all() and own.deviation.tolist() == deviation and own.deviation_exact.tolist() == list(map(str, deviation))
        assert np.allclose(own.explained, share[c - 1], rtol=1e-9)
        sign = np.sign((own.whitened.to_numpy() * whitened[:, c - 1]).sum())
        assert np.abs(sign * own.whitened.to_numpy() - whitened[:, c - 1]).max() < 1e-8
        assert (own.identity_error < 1e-10).all()


@pytest.mark.parametrize("kind", ["random", "shifted", "graded"])
def test_against_numpy(spark, monkeypatch, kind):
    monkeypatch.setattr(W, "CHUNK", 50)
    monkeypatch.setattr(W, "FAN", 2)
    rng = np.random.default_rng(1)
    c = rng.normal(size=(900, 12)) @ rng.normal(size=(12, 12))
    c = c + 1e4 if kind == "shifted" else c * 10.0 ** -np.arange(12) * 100 if kind == "graded" else c
    c[600:] = c[:300]
    c = c.astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), "a", "b", "c") for i, v in enumerate(c)], SCHEMA).repartition(7)
    found = W.whiten(rows).toPandas()
    assert len(found) == 3600 and found.identity_error.nunique() == 1
    compared(found, np.floor(256.0 * c.astype(np.float64)).astype(np.int64), list(range(900)))


def test_lengths_apart_and_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    sizes = [2, 5, 9]
    vectors = {d: rng.normal(size=(40, d)).astype(np.float32) for d in sizes}
    rows = spark.createDataFrame([(1000 * d + i, v.tolist(), "a", "b", "c") for d in sizes for i, v in enumerate(vectors[d])], SCHEMA)
    for numbers in (1 << 20, 20):
        monkeypatch.setattr(W, "MODEL_NUMBERS", numbers)
        found = W.whiten(rows).toPandas()
        assert len(found) == 40 * (2 + 4 + 4)
        for d in sizes:
            compared(found, np.floor(256.0 * vectors[d].astype(np.float64)).astype(np.int64), [1000 * d + i for i in range(40)])


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, None), (2, []), (3, [1.0, nan]), (4, [1.0, None]), (5, [float("inf"), 0.0]), (6, [-0.0, 1e30]), (7, [0.5, -1e30]), (None, [0.5, 0.25]), (8, [3.0]), (8, [3.0])]
    found = W.whiten(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)).collect()
    assert sorted((r["id"] or 0, r["component"]) for r in found) == [(0, 1), (0, 2), (6, 1), (6, 2), (7, 1), (7, 2), (8, 1), (8, 1)]
    alone = [r for r in found if r["id"] == 8]
    assert all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in alone)
    x = [[0, 2**63 - 1], [128, -(2**63)], [128, 64]]
    sums = [sum(c) for c in zip(*x)]
    for r in found:
        if r["id"] != 8:
            own = sum((3 * a - s) ** 2 for a, s in zip(x[{6: 0, 7: 1, None: 2}[r["id"]]], sums))
            assert r["deviation_exact"] == str(own) and r["deviation"] == (own if own < 2**63 else None)


def test_empty(spark):
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_jacobi_keeps_small_values():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    sigma = 10.0 ** -np.arange(0, 10, 0.5)
    got, v = W.jacobi(np.linalg.qr(q * sigma @ np.eye(20), mode="r"))
    assert np.allclose(got, sigma, rtol=1e-11) and np.abs(v @ v.T - np.eye(20)).max() < 1e-13
    assert sorted((a, b) for p, q in W.rounds(7) for a, b in zip(p, q)) == [(a, b) for a in range(7) for b in range(a + 1, 7)]


def test_query_on_given_rows(spark):
    found = op11_whitening(spark, "/root/testdata/sf0.001").toPandas().rename(columns={"vec_id": "id"})
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toPandas()
    x = np.floor(256.0 * np.stack(rows.embedding).astype(np.float64)).astype(np.int64)
    compared(found, x, rows.vec_id.tolist())
