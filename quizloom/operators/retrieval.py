"""Nearest rows of one vector by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_top(rows: DataFrame, query: list[float], searched: int = 10, returned: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ids nearest to the query with their cosine: `searched` are found, the best `returned` of them kept."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector_col)
    cosine = dot(v, q) / (F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
    found = rows.select(id_col, F.round(cosine, 9).alias("score")).orderBy(F.desc("score"), id_col).limit(searched)
    return found.orderBy(F.desc("score"), id_col).limit(returned)
