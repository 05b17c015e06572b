"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept and returns the columns of documents, the last one the pieces of sequences:
documents that the quality classifier rejects go, then toxic ones, then all but one of each near-duplicate group; secrets
are written as placeholders, and the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.llm.common import hand_few, remainder, table, written
from quizloom.llm.near_duplicates import keep_one_of_each
from quizloom.llm.packing import pack
from quizloom.llm.quality import fit_quality, keep_good
from quizloom.llm.secrets import redacted, train
from quizloom.llm.toxicity import fit_toxicity, keep_clean

#: Whole texts that a Python worker of a stage is handed at a time. What a stage returns is run after it, so that this stays set.
BATCH = 500


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score reaches the threshold; NULL and empty texts are scored as texts without features, repeated
    rows each, and no documents give none."""
    hand_few(spark, BATCH)
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score stays below the threshold; NULL and empty texts have no hit and stay, repeated rows are scored
    each, and no documents give none."""
    hand_few(spark, BATCH)
    return keep_clean(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id; documents without an id stay."""
    hand_few(spark, BATCH)
    return keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets written as placeholders and n_chars counted again; NULL texts stay."""
    hand_few(spark, BATCH)
    clean = docs.withColumn("text", redacted(F.col("text"), train(docs), spark))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by sequence: NULL and empty texts have an end id, NULL ids and repeated rows are packed as they come, long
    texts go into many windows, and no documents give no pieces."""
    hand_few(spark, BATCH)
    return pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: Classifiers, connected components and tokenizers are not expressed in SQL; tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
