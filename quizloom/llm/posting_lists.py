"""Approximate nearest neighbours by balanced posting lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import local_best, matrix, one_of_each, usable

#: Rows, those of least hash, that the first level of centroids and the ratio are fitted on, and the second level; at most. All
#: rows are indexed.
SAMPLE, FIT_ROWS = 16_384, 262_144
#: Rows for each list before replication, about; beyond MOST_LISTS lists, a bound on what is broadcast, lists grow instead.
LIST_ROWS, MOST_LISTS = 64, 32_768
#: A row goes to the lists of at most so many centroids, no farther than so many times the nearest.
REPLICAS, REPLICA_RATIO = 4, 1.05
#: The ratio up to which a query reads lists is fitted to this recall on the sample. It is taken to the mean of so many
#: nearest distances, which varies less from query to query than the nearest alone.
RECALL, NEAR = 0.93, 8
#: Links of a centroid in the graph, centroids that a search keeps, at least, and where it is entered: at some lists of some shelves.
DEGREE, WIDTH, ENTRIES, SHELVES = 16, 8, 4, 4
#: Rows and queries of a shelf of lists that meet in one cell, about, and queries scored at a time.
CELL, QUERY_SLICE = 4096, 512


def balanced_centroids(sample: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """Means of groups of like size: each group is halved across the line between two moving means, in proportion to the
    number of lists either half is to give; then come rounds of reassignment to the nearest mean, larger groups costing more."""
    rng = np.random.default_rng(seed)
    means, work = [], [(np.arange(len(sample)), count)]
    while work:
        at, parts = work.pop()
        if parts == 1 or len(at) < 2:
            means.append(sample[at].mean(axis=0))
            continue
        x = sample[at]
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(6):
            order = np.argsort(x @ (b - a), kind="stable")
            a, b = x[order[: len(x) // 2]].mean(axis=0), x[order[len(x) // 2 :]].mean(axis=0)
        order, left = np.argsort(x @ (b - a), kind="stable"), parts // 2
        middle = min(max(1, len(x) * left // parts), len(x) - 1)
        work += [(at[order[:middle]], left), (at[order[middle:]], parts - left)]
    centroids = np.stack(means)
    size = np.full(len(centroids), len(sample) / len(centroids))
    for _ in range(4):
        d = squared(sample, centroids)
        d += d.mean() * 0.05 * (size / size.mean())
        of = d.argmin(axis=1)
        size = np.bincount(of, minlength=len(centroids)).astype(float)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, sample)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    return centroids


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1)[None, :], 0)


class CentroidGraph:
    """The centroids, each linked to the nearest ones of its shelf and of others, to those that it is nearest to, and to the next.
    A search is entered at some centroids of the nearest shelves."""

    def __init__(self, centroids: np.ndarray, shelves: np.ndarray):
        n = len(centroids)
        one, other = [], []
        for first in range(0, n, 1024):
            d = squared(centroids[first : first + 1024], centroids)
            own = first + np.arange(len(d))
            same = shelves[own][:, None] == shelves[None, :]
            d[np.arange(len(d)), own] = np.inf
            for side in (same, ~same):
                masked = np.where(side, d, np.inf)
                near = np.argsort(masked, axis=1, kind="stable")[:, : DEGREE // 2]
                at, column = np.nonzero(np.isfinite(np.take_along_axis(masked, near, axis=1)))
                one.append(own[at])
                other.append(near[at, column])
        one, other = np.concatenate(one), np.concatenate(other)
        ring = np.arange(n)
        one, other = np.concatenate([one, other, ring]), np.concatenate([other, one, (ring + 1) % n])
        links = np.unique(one * n + other)
        self.links, self.first = links % n, np.searchsorted(links // n, np.arange(n + 1))
        self.centroids, self.norms = centroids.astype(np.float32), (centroids**2).sum(axis=1).astype(np.float32)
        members = [np.flatnonzero(shelves == s) for s in np.unique(shelves)]
        self.middles = np.stack([centroids[m].mean(axis=0) for m in members])
        spaced = [np.unique(np.linspace(0, len(m) - 1, ENTRIES).astype(int)) for m in members]
        self.doors = np.full((len(members), ENTRIES), -1)
        for own, m, at in zip(self.doors, members, spaced):
            own[: len(at)] = m[at]

    def distances(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared, up to the row's own norm."""
        return self.norms[at] - 2 * np.matmul(self.centroids[at], x[:, :, None])[:, :, 0]

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The centroids found nearest to each row of x, nearest first, with distances: a best-first search of all rows
        at once, that follows the links of some nearest ones of the beam that it has not followed yet."""
        n, rows = len(self.centroids), np.arange(len(x))[:, None]
        width = min(width, n)
        step = max(4, width // 8)
        nearest = np.argsort(squared(x, self.middles), axis=1, kind="stable")[:, :SHELVES]
        own, x = (x**2).sum(axis=1)[:, None], x.astype(np.float32)
        beam = self.doors[nearest].reshape(len(x), -1)
        far = np.where(beam < 0, np.inf, self.distances(x, beam))
        seen, followed = np.zeros((len(x), n), bool), np.zeros((len(x), n), bool)
        seen[np.nonzero(beam >= 0)[0], beam[beam >= 0]] = True
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            beam, far = np.take_along_axis(beam, order, 1), np.take_along_axis(far, order, 1)
            todo = np.where(followed[rows, beam] | np.isinf(far), np.inf, far)
            if np.isinf(todo).all():
                return beam, np.sqrt(np.maximum(far + own, 0))
            take = np.argpartition(todo, min(step, todo.shape[1]) - 1, axis=1)[:, :step]
            next_ = np.take_along_axis(beam, take, 1)
            live = np.isfinite(np.take_along_axis(todo, take, 1))
            followed[rows, next_] |= live
            # of the centroids that the links lead to, each that is new to its row, once
            at, column = np.nonzero(live)
            node = next_[at, column]
            size = self.first[node + 1] - self.first[node]
            link = np.arange(size.sum()) + np.repeat(self.first[node] - np.cumsum(size) + size, size)
            pairs = np.repeat(at, size) * n + self.links[link]
            pairs = np.unique(pairs[~seen.ravel()[pairs]])
            at, near = pairs // n, pairs % n
            seen[at, near] = True
            counts = np.bincount(at, minlength=len(x))
            place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            fresh, d = np.zeros((len(x), max(1, counts.max(initial=0))), int), np.full((len(x), max(1, counts.max(initial=0))), np.inf)
            fresh[at, place] = near
            d[at, place] = self.norms[near] - 2 * np.einsum("ij,ij->i", self.centroids[near], x[at])
            beam, far = np.concatenate([beam, fresh], axis=1), np.concatenate([far, d], axis=1)


def lifted(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors with one more component, so that the nearest by distance is the one of largest inner product."""
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
    return np.column_stack([x, more]) / longest


class Index:
    """The centroid graph, the shelf of each list (lists of one centroid of the first level share one), and the fitted ratio."""

    def __init__(self, centroids: np.ndarray, shelves: np.ndarray, longest: float):
        self.graph, self.shelves, self.longest, self.ratio = CentroidGraph(centroids, shelves), shelves, longest, 1.0
        self.sizes, self.least = np.ones(len(shelves)), 1

    def posted(self, vectors: np.ndarray) -> np.ndarray:
        """(row, list) of each row's lists: that of its nearest centroid, and a few that are hardly farther."""
        found, far = self.graph.search(lifted(vectors, self.longest, False), WIDTH)
        near = (far <= REPLICA_RATIO * far[:, :1]) & np.isfinite(far)
        near[:, REPLICAS:] = False
        at, column = np.nonzero(near)
        return np.column_stack([at, found[at, column]])

    def ratios(self, far: np.ndarray) -> np.ndarray:
        return far / np.maximum(far[:, :NEAR].mean(axis=1, keepdims=True), 1e-12)

    def read(self, vectors: np.ndarray) -> np.ndarray:
        """(row, list) of the lists that each query reads: the nearest ones that hold the least number of rows together, and all
        within the ratio. The beam is widened until it ends beyond these, so that nothing else bounds the number of lists."""
        x, width = lifted(vectors, self.longest, True), 8 * WIDTH
        todo, out = np.arange(len(x)), []
        while len(todo):
            found, far = self.graph.search(x[todo], width)
            inside = (self.ratios(far) <= self.ratio) & np.isfinite(far)
            held = np.where(np.isfinite(far), self.sizes[found], 0)
            inside |= (np.cumsum(held, axis=1) - held < self.least) & np.isfinite(far)
            done = ~inside[:, -1] | (found.shape[1] == len(self.shelves))
            at, column = np.nonzero(inside & done[:, None])
            out.append(np.column_stack([todo[at], found[at, column]]))
            todo, width = todo[~done], 2 * width
        return np.concatenate(out) if out else np.zeros((0, 2), int)

    def fit_ratio(self, sample: np.ndarray, k: int) -> None:
        """The least ratio at which sampled rows, as queries, find RECALL of their k nearest in the sample."""
        mine = np.full((len(sample), REPLICAS), -1)
        for first in range(0, len(sample), 1024):
            held = self.posted(sample[first : first + 1024])
            mine[first + held[:, 0], np.arange(len(held)) - np.searchsorted(held[:, 0], held[:, 0])] = held[:, 1]
        needed = []
        width = min(k, len(sample) - 1)
        for q in np.array_split(np.linspace(0, len(sample) - 1, min(len(sample), 512)).astype(int), 16):
            if len(q) and width:
                scores = sample[q] @ sample.T
                scores[np.arange(len(q)), q] = -np.inf
                near = np.argpartition(scores, len(sample) - width, axis=1)[:, len(sample) - width :]
                far = np.sqrt(squared(lifted(sample[q], self.longest, True), self.graph.centroids))
                relative = far / np.maximum(np.sort(far, axis=1)[:, :NEAR].mean(axis=1, keepdims=True), 1e-12)
                padded = np.column_stack([relative, np.full(len(q), np.inf)])
                needed.append(padded[np.arange(len(q))[:, None, None], mine[near]].min(axis=2).ravel())
        if needed:
            self.ratio = float(np.quantile(np.concatenate(needed), RECALL))


def second_level(count_of: float, first: np.ndarray, longest: float):
    """Centroids of one shelf, in number by its rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(lifted(matrix(rows["vector"]), longest, False), axis=0)
        found = balanced_centroids(x, max(1, min(round(len(rows) * count_of), len(x))))
        return pd.DataFrame({"shelf": rows["shelf"].iloc[0], "centroid": list(found)})

    return run


def build(rows: DataFrame, n: int, longest: float, k: int) -> Index:
    """Two levels of balanced centroids: the first on the driver, from a bounded sample; the second in one task for each of the
    first, from more rows. Their number grows with the rows."""
    order = [F.xxhash64("id"), "id"]
    sample = matrix(rows.orderBy(*order).limit(SAMPLE).select("vector").toPandas()["vector"])
    lists = max(1, min(-(-n // LIST_ROWS), MOST_LISTS))
    first = balanced_centroids(lifted(sample, longest, False), max(1, min(round(lists**0.5), len(sample) // 2)))
    shared = rows.sparkSession.sparkContext.broadcast(first)

    def on_shelves(batches):
        for batch in batches:
            x = lifted(matrix(batch["vector"]), longest, False)
            yield pd.DataFrame({"shelf": squared(x, shared.value).argmin(axis=1).astype(np.int32), "vector": batch["vector"]})

    share = min(1.0, FIT_ROWS / n)
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else rows
    shelved = chosen.select("vector").mapInPandas(on_shelves, f"shelf int, vector {rows.schema['vector'].dataType.simpleString()}")
    fitted = shelved.groupBy("shelf").applyInPandas(second_level(lists / (share * n), first, longest), "shelf int, centroid array<double>")
    found = fitted.toPandas().sort_values("shelf", kind="stable")
    index = Index(np.stack(found["centroid"].to_numpy()), found["shelf"].to_numpy(), longest)
    index.fit_ratio(sample, max(1, round(k * len(sample) / n)))  # which stand for the k nearest of all
    return index


def on_lists(rows: DataFrame, shared, query: bool) -> DataFrame:
    """(id, vector, shelf, lists): each row once for each shelf on which it stands in lists, or reads some."""
    kind, vector = rows.schema["id"].dataType.simpleString(), rows.schema["vector"].dataType.simpleString()

    def run(batches):
        index = shared.value
        for batch in batches:
            for first in range(0, len(batch), 1024):
                part = batch.iloc[first : first + 1024]
                held = (index.read if query else index.posted)(matrix(part["vector"]))
                frame = pd.DataFrame({"at": held[:, 0], "list": held[:, 1], "shelf": index.shelves[held[:, 1]]})
                grouped = frame.groupby(["at", "shelf"], sort=False)["list"].agg(list).reset_index()
                at = grouped["at"].to_numpy()
                yield pd.DataFrame({"id": part["id"].to_numpy()[at], "vector": part["vector"].to_numpy()[at], "shelf": grouped["shelf"].to_numpy(np.int32), "lists": grouped["list"]})

    return rows.select("id", "vector").mapInPandas(run, f"id {kind}, vector {vector}, shelf int, lists array<int>")


def list_members(lists: pd.Series) -> dict[int, np.ndarray]:
    found: dict[int, list[int]] = {}
    for i, own in enumerate(lists):
        for name in own:
            found.setdefault(name, []).append(i)
    return {name: np.array(at) for name, at in found.items()}


def search_cell(k: int):
    """A query meets the rows of the lists that it reads, and no others, list by list; its k best here are one row."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "ids": [], "scores": []})
        rows = rows.sort_values("id", kind="stable")
        x, ids, standing = matrix(rows["vector"]), rows["id"].to_numpy(), list_members(rows["lists"])
        out = []
        for first in range(0, len(queries), QUERY_SLICE):
            part = queries.iloc[first : first + QUERY_SLICE]
            q, query_ids = matrix(part["vector"]), part["id"].to_numpy()
            scores = np.full((len(q), len(x)), -np.inf)
            for name, readers in list_members(part["lists"]).items():
                if name in standing:
                    scores[np.ix_(readers, standing[name])] = q[readers] @ x[standing[name]].T
            at, column = local_best(scores, ids[None, :] != query_ids[:, None], k)
            exact, cuts = (q[at] * x[column]).sum(axis=1), np.searchsorted(at, np.arange(len(q) + 1))
            parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
            out.append(pd.DataFrame({"query_id": query_ids, "ids": [ids[column[p]] for p in parts], "scores": [exact[p] for p in parts]}))
        return pd.concat(out)

    return run


def merged(k: int):
    """Of rows in the order of their queries, each with some best ids and scores, the k best of each query, an id once. No more
    than a batch and the k best so far are held."""

    def best_of(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["query_id", "score", "id"], ascending=[True, False, True], kind="stable").drop_duplicates(["query_id", "id"])
        return found[found.groupby("query_id").cumcount() < k]

    def ranked(found: pd.DataFrame) -> pd.DataFrame:
        return found.assign(rank=(found.groupby("query_id").cumcount() + 1).astype(np.int32))

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["ids"].map(len).to_numpy(int)
            more = pd.DataFrame({"query_id": np.repeat(batch["query_id"].to_numpy(), sizes), "id": np.concatenate(batch["ids"].to_numpy()), "score": np.concatenate(batch["scores"].to_numpy())})
            found = best_of(more if held is None else pd.concat([held, more], ignore_index=True))
            open_ = found["query_id"] == batch["query_id"].iloc[-1]
            yield ranked(found[~open_])
            held = found[open_]
        if held is not None:
            yield ranked(held)

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each query the k rows of largest inner product that its lists hold.

    Centroids are fitted on bounded samples of the rows, those of least hash. Every row is then written to the lists of
    its nearest centroids, boundary rows to several. A query finds the nearest centroids in the graph and reads the
    lists within a ratio, which is fitted to a recall. Rows with the query's id are its own and no candidates; ties go
    to the smaller id; of repeated rows with one id the best counts. Rows whose vector is NULL, empty, zero or holds a
    NULL, NaN or infinity, or whose id is NULL, take no part. Vectors are compared with those of their own length, each
    length with an index of its own. Other columns are ignored; without rows or queries there are no results.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_col]
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    all_rows = usable(rows, id_col, vector_col).withColumn("norm", norm).filter(F.col("norm") > 0)
    asked = one_of_each(usable(queries, id_col, vector_col).withColumn("norm", norm).filter(F.col("norm") > 0))
    sizes = all_rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
    found = None
    for dim, n, longest in sizes.join(asked.select(F.size("vector").alias("dim")).distinct(), "dim", "left_semi").collect():
        own = of_length(all_rows.filter(F.size("vector") == dim), asked.filter(F.size("vector") == dim), n, longest, k)
        found = own if found is None else found.union(own)
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, score double")
    return found


def of_length(all_rows: DataFrame, asked: DataFrame, n: int, longest: float, k: int) -> DataFrame:
    """nearest for vectors of one length. Of equal vectors all scores are equal, so that the k + 1 of smallest ids are enough."""
    alike = Window.partitionBy("vector").orderBy("id")
    distinct = all_rows.select("id", "vector").distinct().withColumn("place", F.row_number().over(alike)).filter(F.col("place") <= k + 1)
    spark = all_rows.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, n // CELL)  # by the work, which is more than the bytes tell
    index_rows = cut(distinct.select("id", "vector").repartition(tasks, "id"))
    index = build(index_rows, index_rows.count(), longest, k)
    posted = cut(on_lists(index_rows, spark.sparkContext.broadcast(index), False))
    # at most MOST_LISTS counts; so many entries, of at most REPLICAS each, are k rows other than the query's own
    index.sizes[:] = 0
    for r in posted.select(F.explode("lists").alias("list")).groupBy("list").count().collect():
        index.sizes[r["list"]] = r["count"]
    index.least = REPLICAS * (k + 1)
    probes = cut(on_lists(asked.repartition(tasks, "id"), spark.sparkContext.broadcast(index), True))

    def cells(held: DataFrame, name: str) -> DataFrame:
        return held.groupBy("shelf").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))

    sizes = F.broadcast(cells(posted, "row_cells").join(cells(probes, "query_cells"), "shelf"))  # at most sqrt(MOST_LISTS) rows

    key = ["shelf", "row_cell", "query_cell"]

    def dealt(held: DataFrame, own: str, other: str) -> DataFrame:
        cell = F.pmod(F.xxhash64("id", "vector"), F.col(f"{own}s")).cast("int").alias(own)
        return held.join(sizes, "shelf").select("id", "vector", "lists", "shelf", cell, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)).repartition(tasks, *key)

    held, read = dealt(posted, "row_cell", "query_cell"), dealt(probes, "query_cell", "row_cell")
    kind = all_rows.schema["id"].dataType.simpleString()
    found = held.groupBy(*key).cogroup(read.groupBy(*key)).applyInPandas(search_cell(k), f"query_id {kind}, ids array<{kind}>, scores array<double>")
    ordered = found.repartition(tasks, "query_id").sortWithinPartitions("query_id")
    return ordered.mapInPandas(merged(k), f"query_id {kind}, id {kind}, score double, rank int").select("query_id", "rank", "id", "score")
