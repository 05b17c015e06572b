"""Tables as they are shown and exported: joins of questions and chunks, orders, pages, search, and cells as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole(text: Column) -> Column:
    """A key as a number if it is written as one."""
    word = F.trim(text.cast("string"))
    return F.when(word.rlike(r"^[+-]?\d+$"), word.try_cast("long"))


def question_chunks(questions: DataFrame, chunks: DataFrame, how: str = "left") -> DataFrame:
    """Questions with their chunk by its number, however it is written; with how="full_outer" also chunks without questions."""
    q = questions.withColumn("__key", whole(F.col("chunk_id")))
    c = chunks.select(F.col("chunk_id").alias("__chunk"), *[F.col(x).alias(f"chunk_{x}") for x in chunks.columns if x != "chunk_id"])
    found = q.join(c, q["__key"] == c["__chunk"].cast("long"), how)
    return found.withColumn("chunk_id", F.coalesce("chunk_id", F.col("__chunk").cast("string"))).drop("__key", "__chunk")


def chunks_without_questions(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    keys = questions.select(whole(F.col("chunk_id")).alias("__key")).distinct()
    return chunks.join(keys, chunks["chunk_id"].cast("long") == F.col("__key"), "left_anti")


def export_order() -> list[Column]:
    """Numeric chunk ids first, by number, then others by text; then question ids; NULL last."""
    n = whole(F.col("chunk_id"))
    return [n.isNull().asc(), n.asc_nulls_last(), F.col("chunk_id").asc_nulls_last(), F.col("question_id").asc_nulls_last()]


def natural_key(text: Column) -> Column:
    """Text as an array that sorts as people do: runs of digits by value, all else by character without case and accents; signs
    before numbers, numbers before letters."""
    units = F.regexp_extract_all(text, F.lit(r"(\d+|\D)"), 1)
    digits = lambda u: F.regexp_replace(u, r"^0+(?=\d)", "")
    kind = lambda u: F.when(u.rlike(r"^\d"), 1).when(u.rlike(r"^\p{L}"), 2).otherwise(0)
    folded = F.transform(units, lambda u: F.struct(kind(u).alias("kind"), F.when(kind(u) == 1, F.length(digits(u))).otherwise(0).alias("size"), F.collate(digits(u), "UNICODE_CI_AI").alias("text")))
    return F.when(text != "", folded)


def natural_order(column: str, ascending: bool = True) -> list[Column]:
    """Natural order of a column as text; empty and NULL values last when ascending and first when descending."""
    key = natural_key(F.col(column).cast("string"))
    return [key.asc_nulls_last() if ascending else key.desc_nulls_first()]


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of rows in order; a number out of range means the first or last page."""
    total = rows.count()
    last = max(1, -(-total // size))
    number = min(max(number, 1), last)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows in which any of the columns contains the words, without case; blank words find all."""
    words = text.strip().lower()
    if not words:
        return rows
    return rows.filter(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(words)), F.lit(False)) for c in columns]))


def export_columns(rows: DataFrame, first: list[str], names: dict[str, str]) -> DataFrame:
    """The core columns first, then the rest, under their export names."""
    rest = [c for c in rows.columns if c not in first]
    return rows.select(*[c for c in first if c in rows.columns], *rest).withColumnsRenamed(names)


def cells(rows: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text, for formats of flat cells."""
    nested = [c for c, kind in rows.dtypes if kind.startswith(("array", "map", "struct"))]
    return rows.withColumns({c: F.to_json(c) for c in nested}) if nested else rows


def numbered_pages(rows: DataFrame, key: str, order: list, size: int) -> DataFrame:
    """The page number of each row within its key."""
    return rows.withColumn("page", F.ceil(F.row_number().over(Window.partitionBy(key).orderBy(*order)) / size).cast("int"))


def shares(counts: DataFrame, value: str = "n") -> DataFrame:
    """The share in percent of each row, within 0 and 100."""
    total = counts.agg(F.sum(value).alias("total")).scalar()
    share = F.when(total > 0, F.least(F.greatest(100.0 * F.col(value) / total, F.lit(0.0)), F.lit(100.0))).otherwise(0.0)
    return counts.withColumn("share", F.round(share, 6))
