"""The index where it is one: recall and the share of rows scored, on vectors without structure and on clustered ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizloom.llm import posting_lists as P

N, K = 24_000, 20


def vectors(kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(N, 64))
    if kind == "clustered":
        x = rng.normal(size=(300, 64))[rng.integers(0, 300, N)] + 0.35 * x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind, share", [("random", 0.5), ("clustered", 0.1)])
def test_recall_and_rows_scored(spark, kind, share):
    x = vectors(kind)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(8)
    index = P.build(rows, N, 1.0, K)
    assert len(index.shelves) > 300
    asked = np.arange(0, N, 100)
    held, read = index.posted(x), index.read(x[asked])
    lists, scored = P.list_members(held[:, 0:1].tolist()), 0
    of = {}
    for row, name in held:
        of.setdefault(int(name), set()).add(int(row))
    for q in range(len(asked)):
        scored += len(set().union(*[of.get(int(name), set()) for name in read[read[:, 0] == q, 1]]))
    assert lists and scored <= share * N * len(asked)
    assert len(held) < 3.5 * N and set(held[:, 0].tolist()) == set(range(N))

    queries = rows.filter(F.col("id") % 100 == 0)
    found = P.nearest(rows, queries, K, "id", "vector").toPandas().groupby("query_id")["id"].agg(set)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :K]
    assert np.mean([len(found[q] & set(w.tolist())) / K for q, w in zip(asked, want)]) >= 0.9


def test_a_third_of_the_rows_are_one_vector(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x[rng.random(3000) < 0.35] = x[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = P.nearest(rows, rows.filter("vec_id % 20 = 0"), 5).toPandas()
    assert (found.groupby("query_id").size() == 5).all() and found["query_id"].nunique() == 150
    copies = np.flatnonzero((x == x[0]).all(axis=1))
    for q in copies[copies % 20 == 0]:
        want = [i for i in copies if i != q][:5]
        own = found[found["query_id"] == q].sort_values("rank")
        if (x @ x[q]).max() == x[q] @ x[q]:
            assert own["id"].tolist() == want


def test_several_lengths(spark):
    rng = np.random.default_rng(9)
    x = [rng.normal(size=(8, 16)[i % 3 == 0]).tolist() for i in range(600)]
    rows = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    found = P.nearest(rows, rows.filter("vec_id % 20 = 0"), 5).toPandas()
    assert found["query_id"].nunique() == 30 and all(len(x[q]) == len(x[i]) for q, i in zip(found["query_id"], found["id"]))
