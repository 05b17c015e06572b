"""Whitening of vectors: blockwise TSQR of the centred rows to R, one-sided Jacobi rotations of R's columns."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import written
from .vectors import complete

COMPONENTS, SCALE = 4, 256.0
#: Rows of one QR step, triangles merged by one task, and numbers that models of one pass may hold (8 MB; each length of
#: vectors has a model, further lengths take further passes).
CHUNK, FAN, MODEL_NUMBERS = 2048, 16, 1 << 20
#: Columns count as orthogonal below this cosine, and a component as without deviation below this share of the first one's (times
#: the dimensions). Sweeps end when nothing was rotated; this many are never needed.
COSINE, NOTHING, SWEEPS = 1e-15, 1e-15, 60
LONGEST = 2**63 - 1


def integers(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * c) of each entry as a long; what lies beyond long is its nearest end."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(scale)))


def by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix of long) of the vectors of each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield int(length), rows, values[(ends[rows] - length)[:, None] + np.arange(length)]


def exact_sum(x: np.ndarray) -> list[int]:
    """The sums of the columns of a matrix of long, without overflow."""
    if len(x) * max(-int(x.min()), int(x.max()), 1) < LONGEST:
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: of long where that holds them, else of Python's integers."""
    if n * max(-int(x.min()), int(x.max()), 1) + max(map(abs, sums)) < LONGEST:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (numerators(x, n, sums) / n).astype(np.float64)


def square_sums(x: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if x.dtype != object and x.shape[1] * max(-int(x.min()), int(x.max()), 1) ** 2 < LONGEST:
        return (x * x).sum(axis=1).tolist()
    return (x.astype(object) ** 2).sum(axis=1).tolist()


def sums_of(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """length -> (vectors, sums by dimension), from partial sums of the input partitions, one row for each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for length, rows, x in by_length(batch.column("x")) if batch.num_rows else ():
                n, sums = found.get(length, (0, [0] * length))
                found[length] = n + len(rows), [a + b for a, b in zip(sums, exact_sum(x))]
        rows = [(length, i, n, Decimal(s)) for length, (n, sums) in found.items() for i, s in enumerate(sums)]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)))], ["length", "dim", "n", "total"])

    parts = fit.mapInArrow(partial, "length int, dim int, n long, total decimal(38,0)")
    whole = parts.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    listed = whole.groupBy("length").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "total"))).alias("sums"))
    return {r["length"]: (r["n"], [int(s["total"]) for s in r["sums"]]) for r in listed.collect()}


def stacked(triangles: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(triangles), mode="r")


def triangles(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """(length, triangle): R of all centred rows of each length. Partitions make theirs from chunks of rows, and those are merged
    by tasks that take FAN at a time."""
    means = fit.sparkSession.sparkContext.broadcast(sums)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in by_length(batch.column("x")) if batch.num_rows else ():
                for at in range(0, len(x), CHUNK):
                    rows = centred(x[at : at + CHUNK], *means.value[length])
                    found[length] = stacked([found[length], rows] if length in found else [rows])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([part] * len(found), pa.int32()), pa.array([r.tobytes() for r in found.values()], pa.binary())], ["length", "part", "triangle"])

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        r = stacked([np.frombuffer(t).reshape(-1, key[0]) for t in rows.sort_values("part")["triangle"]])
        return pd.DataFrame({"length": [key[0]], "part": [key[1]], "triangle": [r.tobytes()]})

    found = written(fit.mapInArrow(local, "length int, part int, triangle binary"))
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // FAN)
        found = written(found.groupBy("length", F.floor(F.col("part") / FAN).cast("int").alias("part")).applyInPandas(merge, "length int, part int, triangle binary"))
    return found.select("length", "triangle")


def rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every two of d columns once, in rounds of pairs that share no column."""
    ring, out = list(range(d + d % 2)), []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring)) if max(a, b) < d]
        out.append((np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values falling, right singular vectors as rows): plane rotations of the columns until all are orthogonal, accumulated.

    The largest entry of each vector is positive.
    """
    d = r.shape[1]
    a, v, pairs = r.T.copy(), np.eye(d), rounds(d)
    for _ in range(SWEEPS):
        turned = False
        for p, q in pairs:
            x, y = a[p], a[q]
            xx, yy, xy = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            todo = np.abs(xy) > COSINE * np.sqrt(xx) * np.sqrt(yy)
            if not todo.any():
                continue
            turned, p, q, xx, yy, xy = True, p[todo], q[todo], xx[todo], yy[todo], xy[todo]
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            c, s = c[:, None], (c * t)[:, None]
            for m in (a, v):
                m[p], m[q] = c * m[p] - s * m[q], s * m[p] + c * m[q]
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(axis=1))
    order = np.argsort(-sigma, kind="stable")
    v = v[order] / np.linalg.norm(v[order], axis=1, keepdims=True)
    return sigma[order], v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=1)[:, None], axis=1) < 0, -1.0, 1.0)


def components(triangle: DataFrame, k: int) -> DataFrame:
    """(length, component, sigma, share, axis) of the first k components."""

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sigma, v = jacobi(np.frombuffer(rows["triangle"].iloc[0]).reshape(-1, key[0]))
        whole, first = (sigma**2).sum(), min(k, key[0])
        return pd.DataFrame({"length": key[0], "component": np.arange(1, first + 1), "sigma": sigma[:first], "share": [s * s / whole if whole else None for s in sigma[:first]], "axis": list(v[:first])})

    return triangle.groupBy("length").applyInPandas(of, "length int, component int, sigma double, share double, axis array<double>")


class Model:
    """What whitens vectors of one length."""

    def __init__(self, n: int, sums: list[int], rows: list) -> None:
        self.n, self.sums = n, sums
        self.axes = np.array([r["axis"] for r in rows])
        self.share = [r["share"] for r in rows]
        sigma = np.array([r["sigma"] for r in rows])
        self.real = sigma > NOTHING * len(sums) * sigma[0]
        self.deviation = np.where(self.real, sigma / np.sqrt(n), 1.0)
        self.error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column for each component; NaN where that has no deviation."""
        return np.where(self.real, centred(x, self.n, self.sums) @ self.axes.T / self.deviation, np.nan)


def identity_errors(fit: DataFrame, models: dict[int, Model], k: int) -> dict[int, float]:
    """length -> the largest absolute entry of the covariance of the whitened fit list minus the identity."""
    shared = fit.sparkSession.sparkContext.broadcast(models)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, x in by_length(batch.column("x")) if batch.num_rows else ():
                w = shared.value[length].whitened(x)
                w = np.hstack([w, np.full((len(w), k - w.shape[1]), np.nan)])
                yield pa.RecordBatch.from_arrays([pa.array([length] * len(rows), pa.int32()), *[pa.array(c, from_pandas=True) for c in w.T]], ["length", *[f"w{i}" for i in range(k)]])

    whitened = fit.mapInArrow(of, StructType([StructField("length", IntegerType()), *[StructField(f"w{i}", DoubleType()) for i in range(k)]]))
    entries = [F.abs(F.covar_pop(f"w{i}", f"w{j}") - F.lit(float(i == j))) for i in range(k) for j in range(i, k)]
    return {r["length"]: r["error"] for r in whitened.groupBy("length").agg(F.array_max(F.array(*entries)).alias("error")).collect()}


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS, scale: float = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, deviation_exact) for each row with a complete vector and
    each of the first k components, fewer if the vectors are shorter.

    Vectors that are NULL, empty or hold NULL or non-finite entries are left out. Entries become floor(scale * c). The fit takes
    each distinct vector once; vectors of each length are a space of their own. Rows with a NULL id and repeated rows are
    whitened like others, other columns are ignored, no rows give no rows. A component without any deviation, as where there is
    one distinct vector, has NULL as whitened and takes no part in identity_error; if none has any, explained and identity_error
    are NULL. A deviation beyond long is NULL as `deviation` and whole in `deviation_exact`, its digits.
    To the driver come sums and first components of as many lengths at a time as 2^20 numbers hold.
    """
    spark = rows.sparkSession
    kept = rows.filter(complete(F.col(vector_col))).select(F.col(id_col).alias("id"), integers(F.col(vector_col), scale).alias("x"))
    fit = written(kept.select("x").distinct())
    fields = [StructField(name, kind()) for name, kind in (("component", IntegerType), ("n", LongType), ("deviation", LongType), ("whitened", DoubleType), ("explained", DoubleType), ("identity_error", DoubleType), ("deviation_exact", StringType))]
    schema = StructType([StructField("id", kept.schema["id"].dataType), *fields])
    form, out = to_arrow_schema(schema), spark.createDataFrame([], schema)
    lengths = [r[0] for r in fit.select(F.size("x").alias("length")).distinct().orderBy("length").collect()]
    for block in blocks_of(lengths, k):
        here = F.size("x").between(block[0], block[-1])
        own = fit.filter(here)
        sums = sums_of(own)
        found = components(triangles(own, sums), k).orderBy("length", "component").collect()
        models = {length: Model(*sums[length], [r for r in found if r["length"] == length]) for length in block}
        for length, error in identity_errors(own, models, k).items():
            models[length].error = error
        shared = spark.sparkContext.broadcast(models)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for length, at, x in by_length(batch.column("x")) if batch.num_rows else ():
                    m = shared.value[length]
                    first = len(m.share)
                    squares = square_sums(numerators(x, m.n, m.sums))
                    each = lambda values: [v for v in values for _ in range(first)]
                    columns = [batch.column("id").take(pa.array(np.repeat(at, first))), list(range(1, first + 1)) * len(at), [m.n] * (len(at) * first), each([s if s <= LONGEST else None for s in squares])]
                    columns += [m.whitened(x).ravel(), m.share * len(at), [m.error] * (len(at) * first), each(map(str, squares))]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, form)], schema=form)

        out = out.unionAll(kept.filter(here).mapInArrow(score, schema)) if len(block) < len(lengths) else kept.mapInArrow(score, schema)
    return out


def blocks_of(lengths: list[int], k: int) -> list[list[int]]:
    """The lengths in blocks whose models hold MODEL_NUMBERS numbers at most, or one length."""
    blocks, room = [], 0
    for length in lengths:
        if not blocks or room < length * (k + 1):
            blocks.append([])
            room = MODEL_NUMBERS
        blocks[-1].append(length)
        room -= length * (k + 1)
    return blocks
