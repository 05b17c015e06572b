"""A bounded sample of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: dict[int, int], rows: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label, weight) of at most most[label] labelled ids for each label, those of least hash.

    rows, a condition on the id, tells which labels may be learnt from. Ids are chosen from the labels alone, so that
    what is broadcast to meet the texts is bounded. An id with several labels counts with the largest one; NULL labels,
    NULL ids and NULL texts are left out. Of an id that docs repeats the least text counts. The weight of a row is the
    number of labelled ids of its label for each one chosen, so that weighted rows stand in the labels' own proportion.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.filter(rows) if rows is not None else known
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = None
    for label, limit in most.items():
        own = known.filter(F.col("label") == label)
        count = own.agg(F.greatest(F.lit(1.0), F.count("*") / F.lit(float(limit))).alias("weight"))
        part = own.orderBy(F.xxhash64("id"), "id").limit(limit).crossJoin(F.broadcast(count))
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"), F.max("weight").alias("weight"))
