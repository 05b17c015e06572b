"""Exact top-k search by inner product of integer vectors, with a uniform threshold in three phases."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_folder
from .vectors import best, usable

#: Score lists of a query: the parts of its scores that come from this many fragments of the dimensions.
FRAGMENTS = 2
#: Numbers in a block of queries, the only thing that is broadcast, about; candidates that are scored at a time; rows of a task.
BLOCK_NUMBERS, SLICE, TASK_ROWS = 2**18, 1024, 2**16
#: Components up to this size are listed in floating point; rows with larger ones are resolved outright.
LISTED = 2.0**40
LEAST, MOST = -(2**63), 2**63 - 1


def integers(vector, scale: float) -> list[int]:
    """floor(scale * component) of each component, whatever its size."""
    return [math.floor(Fraction(float(x)) * Fraction(scale)) for x in vector]


def as_long(score: int) -> int:
    return min(max(score, LEAST), MOST)


class Vectors:
    """Rows of one length: ids, integer components as doubles, their fragments, and the norms of these. Rows with very large
    components stand apart, as Python integers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: float):
        with np.errstate(over="ignore"):
            x = np.floor(scale * vectors)
        small = (np.abs(x) <= LISTED).all(axis=1)
        self.ids, self.x = ids[small], x[small]
        self.large = [(i, integers(v, scale)) for i, v in zip(ids[~small], vectors[~small])]
        self.parts = np.array_split(np.arange(x.shape[1]), max(1, min(FRAGMENTS, x.shape[1])))
        self.norms = np.stack([np.sqrt((self.x[:, p] ** 2).sum(axis=1)) for p in self.parts])
        self.top = float(np.abs(self.x).max(initial=0))

    def exact(self, own: np.ndarray, other: "Vectors", at: np.ndarray) -> np.ndarray:
        """The scores of pairs of rows, own[i] here and at[i] there: in doubles where these are exact, as Python integers else."""
        a, b = self.x[own], other.x[at]
        if self.top * other.top * a.shape[1] < 2.0**53:
            return np.einsum("ij,ij->i", a, b).astype(np.int64)
        return np.array([as_long(sum(int(u) * int(v) for u, v in zip(p, q))) for p, q in zip(a, b)], np.int64)


def by_length(frame: pd.DataFrame, scale: float) -> dict[int, Vectors]:
    lengths = frame["vector"].map(len).to_numpy(int)
    found = {}
    for n in np.unique(lengths):
        rows = frame[lengths == n]
        found[int(n)] = Vectors(rows["id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(np.float64).reshape(len(rows), n), scale)
    return found


def large_scores(queries: Vectors, candidates: Vectors) -> Iterator[tuple[object, object, int]]:
    """(query, candidate, score) of all pairs with a very large component on either side."""
    plain = lambda v: [(i, [int(c) for c in x]) for i, x in zip(v.ids, v.x)]
    pairs = []
    if queries.large:
        pairs.append((queries.large, plain(candidates) + candidates.large))
    if candidates.large:
        pairs.append((plain(queries), candidates.large))
    for some, others in pairs:
        for i, a in some:
            for j, b in others:
                if i != j:
                    yield i, j, as_long(sum(u * v for u, v in zip(a, b)))


class Running:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.frame = k, None

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(query):
            return
        more = pd.DataFrame({"query_id": query, "id": ids, "score": np.asarray(scores, np.int64)})
        more = more if self.frame is None else pd.concat([self.frame, more], ignore_index=True)
        more = more.sort_values(["query_id", "score", "id"], ascending=[True, False, True], kind="stable")
        self.frame = more[more.groupby("query_id", sort=False).cumcount() < self.k]

    def cutoffs(self, ids: np.ndarray) -> np.ndarray:
        """The k-th best score of each query, minus infinity while there are fewer."""
        if self.frame is None:
            return np.full(len(ids), -np.inf)
        counts = self.frame.groupby("query_id")["score"].agg(["size", "min"])
        full = counts["min"][counts["size"] == self.k].astype(float)
        return full.reindex(ids).fillna(-np.inf).to_numpy()


def lists(queries: Vectors, candidates: Vectors, asked: np.ndarray) -> list[np.ndarray]:
    """The local score lists: for each fragment its part of the scores of the asked queries with all candidates."""
    return [queries.x[np.ix_(asked, p)] @ candidates.x[:, p].T for p in queries.parts]


def heads(queries: Vectors, candidates: Vectors, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase one: the k entries that head each local list, as row numbers of queries and candidates, each pair once."""
    asked = np.arange(len(queries.ids))
    other = candidates.ids[None, :] != queries.ids[:, None]
    seen = np.zeros(other.shape, bool)
    width = min(k, other.shape[1])
    for part in lists(queries, candidates, asked):
        masked = np.where(other, part, -np.inf)
        at = np.argpartition(masked, masked.shape[1] - width, axis=1)[:, masked.shape[1] - width :]
        np.put_along_axis(seen, at, True, axis=1)
    return np.nonzero(seen & other)


def sufficient(queries: Vectors, candidates: Vectors, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase two: the entries that can reach their query's cutoff, as row numbers.

    A query whose norms, fragment by fragment, cannot bring it to its cutoff with any candidate here skips them all. For the
    others each of n lists gives its entries of at least cutoff / n: what stands in none of them cannot reach the cutoff.
    An entry's listed parts, and for the others what the norms and cutoff / n allow, then bound its score.
    """
    n = len(queries.parts)
    slack = 1e-9 * np.maximum(1.0, (queries.norms * candidates.norms.max(axis=1, initial=0)[:, None]).sum(axis=0))
    reach = (queries.norms * candidates.norms.max(axis=1, initial=0)[:, None]).sum(axis=0) + slack
    asked = np.flatnonzero(reach >= cutoff)
    if not len(asked) or not len(candidates.ids):
        return np.zeros(0, int), np.zeros(0, int)
    share, slack = cutoff[asked, None] / n, slack[asked, None]
    parts = lists(queries, candidates, asked)
    rows, columns = np.nonzero(np.logical_or.reduce([p >= share - slack for p in parts]))
    least, bound = share[rows, 0], np.zeros(len(rows))
    for f, p in enumerate(parts):
        own = p[rows, columns]
        room = np.minimum(least, queries.norms[f][asked[rows]] * candidates.norms[f][columns])
        bound += np.where(own >= least, own, np.where(np.isneginf(least), np.inf, room))
    possible = (bound + slack[rows, 0] >= cutoff[asked[rows]]) & (queries.ids[asked[rows]] != candidates.ids[columns])
    return asked[rows[possible]], columns[possible]


def slices(batches, scale: float) -> Iterator[tuple[int, Vectors]]:
    for batch in batches:
        for first in range(0, len(batch), SLICE):
            yield from by_length(batch.iloc[first : first + SLICE], scale).items()


def local_scores(shared, k: int, scale: float):
    """Phase one in a task: the k best resolved heads of each query of the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, found = by_length(shared.value, scale), Running(k)
        for n, candidates in slices(batches, scale):
            if n in queries:
                own = queries[n]
                for q, c, s in large_scores(own, candidates):
                    found.add([q], [c], [s])
                if len(own.ids) and len(candidates.ids):
                    rows, columns = heads(own, candidates, k)
                    found.add(own.ids[rows], candidates.ids[columns], own.exact(rows, candidates, columns))
        if found.frame is not None:
            yield found.frame

    return run


def resolved(shared, cutoffs, k: int, scale: float):
    """Phases two and three in a task: sufficient entries are gathered and resolved; the k best of each query go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, found = by_length(shared.value, scale), Running(k)
        for n, candidates in slices(batches, scale):
            if n in queries:
                own = queries[n]
                for q, c, s in large_scores(own, candidates):
                    found.add([q], [c], [s])
                cutoff = np.array([cutoffs.value.get(i, -np.inf) for i in own.ids])
                rows, columns = sufficient(own, candidates, np.maximum(cutoff, found.cutoffs(own.ids)))
                found.add(own.ids[rows], candidates.ids[columns], own.exact(rows, candidates, columns))
        if found.frame is not None:
            yield found.frame

    return run


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, id, score): for each query the k rows of largest inner product of floor(scale * component).

    Rows with the query's id are its own and no candidates. Ties go to the smaller id; with fewer than k candidates all
    are returned. Rows whose vector is NULL or holds a NULL, NaN or infinity, or whose id is NULL, take no part. Vectors
    are compared with those of their own length, empty ones with score 0. A query id that is repeated is one query, with
    its least vector; repeated candidates each count. Scores are exact; one that a long cannot hold counts as the nearest
    long. Other columns are ignored; no rows or no queries give no rows.

    Candidates lie ordered by norm, so that slices of small norms can be skipped, and are never copied. Queries are
    broadcast in blocks of bounded size, one after the other, each with its cutoffs for the second pass. A task gives at
    most k entries for a query.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)[id_col]
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    candidates = usable(rows, id_col, vector_col, empty=True)
    asked = cut(usable(queries, id_col, vector_col, empty=True).groupBy("id").agg(F.min("vector").alias("vector")))
    n, longest = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score long")
    tasks = max(spark.sparkContext.defaultParallelism, -(-candidates.count() // TASK_ROWS))
    dealt = cut(candidates.repartitionByRange(tasks, F.desc(norm), F.xxhash64("id")))
    blocks = -(-n * max(1, longest) // BLOCK_NUMBERS)
    folder = f"{shared_folder(spark)}/top-{uuid.uuid4().hex}"
    schema = f"query_id {kind}, id {kind}, score long"
    for number in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toPandas()
        if not len(block):
            continue
        shared = spark.sparkContext.broadcast(block)
        first = best(dealt.mapInPandas(local_scores(shared, k, scale), schema), k)
        safe = first.groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("n")).filter(F.col("n") == k)
        cutoffs = spark.sparkContext.broadcast({r["query_id"]: float(r["cutoff"]) for r in safe.collect()})
        best(dealt.mapInPandas(resolved(shared, cutoffs, k, scale), schema), k).write.mode("append").parquet(folder)
        shared.unpersist()
        cutoffs.unpersist()
    return spark.read.schema(f"query_id {kind}, rank int, id {kind}, score long").parquet(folder)
