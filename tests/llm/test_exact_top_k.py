"""Exact top-k over several slices, tasks and blocks of queries, with products counted, and scores of any size."""

import numpy as np
import pytest

from quizloom.llm import exact_top_k as E


def plain(x, queries, k, ids=None):
    y = [E.integers(v, 256.0) for v in x]
    ids = range(len(x)) if ids is None else ids
    found = {}
    for q in queries:
        own = y[ids.index(q)] if isinstance(ids, list) else y[q]
        scores = [(-E.as_long(sum(a * b for a, b in zip(own, v))), i) for i, v in zip(ids, y) if i != q and len(v) == len(own)]
        found[q] = [(-s, i) for s, i in sorted(scores)[:k]]
    return found


def got(frame):
    out = {}
    for r in frame.sort_values(["query_id", "rank"]).itertuples():
        out.setdefault(r.query_id, []).append((r.score, r.id))
    return out


@pytest.mark.parametrize("kind", ["random", "ties", "norms"])
def test_over_several_slices_and_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(E, "SLICE", 128)
    monkeypatch.setattr(E, "BLOCK_NUMBERS", 256)
    monkeypatch.setattr(E, "TASK_ROWS", 300)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 16)) if kind != "ties" else rng.integers(-1, 2, (1200, 16)) / 2
    if kind == "norms":
        x *= rng.exponential(1, (1200, 1)) ** 2
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = got(E.exact_top_k(rows, rows.filter("vec_id % 50 = 0"), 5).toPandas())
    assert found == plain(x, range(0, 1200, 50), 5)


def test_sums_are_made_for_sufficient_entries_only():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries, candidates = E.Vectors(np.arange(80), x[:80], 256.0), E.Vectors(np.arange(4000), x, 256.0)
    scores = queries.x @ candidates.x.T
    scores[np.arange(80), np.arange(80)] = -np.inf
    cutoff = np.sort(scores, axis=1)[:, -5]
    rows, columns = E.heads(queries, candidates, 5)
    assert len(rows) <= 80 * 5 * E.FRAGMENTS
    rows, columns = E.sufficient(queries, candidates, cutoff)
    assert len(rows) < 0.05 * scores.size
    assert set(zip(*np.nonzero(scores >= cutoff[:, None]))) <= set(zip(rows.tolist(), columns.tolist()))


def test_slices_of_small_norms_are_skipped(monkeypatch):
    rng = np.random.default_rng(3)
    queries, candidates = E.Vectors(np.arange(3), rng.normal(size=(3, 8)), 256.0), E.Vectors(np.arange(10, 500), rng.normal(size=(490, 8)) / 100, 256.0)
    monkeypatch.setattr(E, "lists", lambda *_: pytest.fail("a list was made"))
    assert len(E.sufficient(queries, candidates, np.full(3, 256.0**2))[0]) == 0


def test_scores_of_any_size(spark):
    x = [[2.0**21, 0.0], [2.0**21, 0.0], [1.0, 1.0], [2.0**30, -1.5], [-(2.0**45), 3.25], [1e30, 1.0], [1e307, -1e307], [2.0**23 + 1, 2.0**23 - 1]]
    rows = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    found = got(E.exact_top_k(rows, rows, 3).toPandas())
    assert found == plain(x, range(len(x)), 3)
    pair = spark.createDataFrame(list(enumerate(x[:2])), "vec_id long, embedding array<double>")
    assert got(E.exact_top_k(pair, pair, 3).toPandas())[0] == [(288230376151711744, 1)]


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    x = [rng.normal(size=n).tolist() for n in rng.choice([0, 1, 2, 7, 16], 150)]
    rows = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    found = got(E.exact_top_k(rows, rows.filter("vec_id % 10 = 0"), 4).toPandas())
    assert found == plain(x, range(0, 150, 10), 4)
