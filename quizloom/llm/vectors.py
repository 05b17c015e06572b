"""Reading of vectors for the search operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete(vector: Column, empty: bool = False) -> Column:
    """Whether a vector is there and holds finite numbers only; whether empty ones count is told by the caller."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) >= (0 if empty else 1)) & finite, F.lit(False))


def usable(rows: DataFrame, id_col: str, vector_col: str, empty: bool = False) -> DataFrame:
    """(id, vector) of the rows with an id and a complete vector."""
    found = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    return found.filter(F.col("id").isNotNull() & complete(F.col("vector"), empty))


def one_of_each(queries: DataFrame) -> DataFrame:
    """One row for each id; of repeated rows the least vector."""
    return queries.groupBy("id").agg(F.min("vector").alias("vector"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def best(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) of the k highest scores of each query, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return pairs.select("query_id", "id", "score", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def local_best(scores: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best kept entries of each row, ties to the first column."""
    width = min(k, scores.shape[1])
    masked = np.where(keep, scores, -np.inf)
    order = np.argsort(-masked, axis=1, kind="stable")[:, :width] if width * 8 > scores.shape[1] else cut_first(masked, width)
    rows = np.repeat(np.arange(scores.shape[0]), width)
    columns = order.ravel()
    valid = masked[rows, columns] > -np.inf
    return rows[valid], columns[valid]


def cut_first(masked: np.ndarray, width: int) -> np.ndarray:
    """As a stable argsort's first columns: what lies above the width-th largest value, and the first of those equal to it."""
    least = np.partition(masked, masked.shape[1] - width, axis=1)[:, masked.shape[1] - width, None]
    above = masked > least
    equal = masked == least
    room = width - above.sum(axis=1, keepdims=True)
    chosen = above | (equal & (np.cumsum(equal, axis=1) <= room))
    columns = np.nonzero(chosen)[1].reshape(masked.shape[0], width)
    order = np.argsort(-np.take_along_axis(masked, columns, axis=1), axis=1, kind="stable")
    return np.take_along_axis(columns, order, axis=1)
