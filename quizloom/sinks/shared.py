"""Folders that all executors share, and rows written there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder; where none is set, a temporary one in local mode, else one in the warehouse."""
    context = spark.sparkContext
    shared = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        shared = tempfile.gettempdir() if context.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{shared}/work-{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """The rows as a table of their own: what made them, such as a model's answers, is not asked for again."""
    folder = work_folder(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
